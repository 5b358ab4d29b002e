"""Transit feeds: typed members, services active on a date, and the slice of a feed that a date needs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The numeric columns of the members of a feed.
INTEGERS = {
    "routes": ["route_type", "route_sort_order"], "trips": ["direction_id", "wheelchair_accessible", "bikes_allowed"], "stops": ["location_type", "wheelchair_boarding"], "stop_times": ["stop_sequence", "pickup_type", "drop_off_type", "timepoint"],
    "calendar": ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"], "calendar_dates": ["exception_type"], "shapes": ["shape_pt_sequence"], "frequencies": ["headway_secs", "exact_times"],
}
FLOATS = {"stops": ["stop_lat", "stop_lon"], "stop_times": ["shape_dist_traveled"], "shapes": ["shape_pt_lat", "shape_pt_lon", "shape_dist_traveled"]}
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def typed_member(df: DataFrame, table: str) -> DataFrame:
    """All-text rows of a member with its numeric columns typed; what can't be read is null, an empty text too."""
    blank = df.select(*(F.when(F.col(c) != "", F.col(c)).alias(c) for c in df.columns))
    whole = lambda c: F.when(F.col(c).try_cast("double") == F.floor(F.col(c).try_cast("double")), F.col(c).try_cast("double").cast("bigint"))
    kinds = {c: whole(c) for c in INTEGERS.get(table, ()) if c in df.columns} | {c: F.col(c).try_cast("double") for c in FLOATS.get(table, ()) if c in df.columns}
    return blank.withColumns(kinds) if kinds else blank


def feed_date(col: str) -> Column:
    """A date written yyyyMMdd; anything else is null."""
    text = F.trim(F.col(col).cast("string"))
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))


def active_services(calendar: DataFrame | None, calendar_dates: DataFrame | None, day: date, by: list[str] | None = None) -> DataFrame:
    """(by, service_id) active on ``day``: by weekday within its dates, an unreadable date being no bound, with additions,
    and without removals, which win over additions."""
    keys = [*(by or []), "service_id"]
    parts = []
    if calendar is not None:
        flag = F.col(WEEKDAYS[day.weekday()]).cast("string")
        runs = F.coalesce(flag.try_cast("int") != 0, F.lower(F.trim(flag)) == "true", F.lit(False))
        start, end = F.coalesce(feed_date("start_date") <= F.lit(day), F.lit(True)), F.coalesce(feed_date("end_date") >= F.lit(day), F.lit(True))
        parts.append(calendar.where(runs & start & end).select(*keys))
    if calendar_dates is not None:
        today = calendar_dates.where(F.col("date").cast("string") == day.strftime("%Y%m%d"))
        added, removed = (today.where(F.col("exception_type").cast("int") == n).select(*keys) for n in (1, 2))
        active = (parts[0].unionByName(added) if parts else added).distinct()
        return active.join(removed, keys, "left_anti")
    return parts[0].distinct()


def service_slice(tables: dict[str, DataFrame], day: date | None, by: list[str] | None = None) -> dict[str, DataFrame]:
    """The rows of a feed that ``day`` needs: trips of active services, their stop times, routes, stops and shapes.

    Without a day the feed is whole. ``by`` names columns (such as a feed key) that keep several feeds apart. Tables
    that have no part in services are left out of a slice.
    """
    if day is None:
        return dict(tables)
    by = by or []
    services = active_services(tables.get("calendar"), tables.get("calendar_dates"), day, by)
    out: dict[str, DataFrame] = {}

    def keep(name: str, key: str, ids: DataFrame) -> None:
        if name in tables and key in ids.columns:
            out[name] = tables[name].join(ids.select(*by, key).where(F.col(key).isNotNull()).distinct(), [*by, key], "left_semi")

    keep("trips", "service_id", services)
    if "trips" in out:
        keep("stop_times", "trip_id", out["trips"])
        keep("routes", "route_id", out["trips"])
        keep("shapes", "shape_id", out["trips"])
        keep("frequencies", "trip_id", out["trips"])
    if "stop_times" in out:
        keep("stops", "stop_id", out["stop_times"])
    keep("calendar", "service_id", services)
    if "calendar_dates" in tables:
        out["calendar_dates"] = tables["calendar_dates"].where(F.col("date").cast("string") == day.strftime("%Y%m%d"))
    return out


def table_hash(df: DataFrame) -> DataFrame:
    """(hash): a hash of a table's rows as a set with counts, whatever their order: of the sums of row hashes."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    sums = df.select(F.xxhash64(row).alias("a"), F.xxhash64(row, F.lit(1)).alias("b")).agg(F.sum(F.col("a").cast("decimal(20,0)")).alias("a"), F.sum(F.col("b").cast("decimal(20,0)")).alias("b"), F.count(F.lit(1)).alias("n"))
    return sums.select(F.sha2(F.concat_ws("|", F.lit("v1"), "a", "b", "n", F.lit(",".join(sorted(df.columns)))), 256).alias("hash"))


def trips_per_route(trips: DataFrame, by: list[str] | None = None) -> DataFrame:
    return trips.groupBy(*(by or []), "route_id").agg(F.countDistinct("trip_id").alias("n_trips"))
