"""Named types, their promotion lattice and values written as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.ids import strip

# The spellings of each named type.
SPELLINGS = {
    "integer": ["int", "int64", "bigint", "long", "integer"],
    "float": ["float", "double", "float64"],
    "string": ["str", "string", "varchar", "text"],
    "boolean": ["bool", "boolean"],
    "date": ["date"],
    "timestamp": ["timestamp", "datetime"],
    "json": ["json"],
    "null": ["null"],
}
SPARK_TYPES = {"integer": "bigint", "float": "double", "string": "string", "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz", "json": "string", "null": "string", "number": "string"}

NUMBER = "decimal(38,10)"
#: A number as it is written.
NUMERAL = r"\A[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"


def named_type(col: Column | str) -> Column:
    """The named type of any spelling; unknown spellings stay, stripped and in lower case."""
    text = F.lower(strip(col))
    known = [F.when(text.isin(spelled), F.lit(name)) for name, spelled in SPELLINGS.items()]
    return F.coalesce(*known, text)


def promote(kinds: set[str]) -> str:
    """The least type that holds values of all ``kinds``: null < boolean | integer < float | date < timestamp; else string."""
    kinds = kinds - {"null"}
    if len(kinds) <= 1:
        return next(iter(kinds), "string")
    for holds in ({"integer", "float"}, {"date", "timestamp"}):
        if kinds <= holds:
            return "float" if "float" in holds else "timestamp"
    return "string"


def promoted(kinds: Column) -> Column:
    """:func:`promote` over an array of type names."""
    some = F.array_distinct(F.filter(kinds, lambda k: k.isNotNull() & (k != "null")))
    inside = lambda *names: F.size(F.array_except(some, F.array(*map(F.lit, names)))) == 0
    return (
        F.when(F.size(some) == 0, "string").when(F.size(some) == 1, F.element_at(some, 1)).when(inside("integer", "float"), "float").when(inside("date", "timestamp"), "timestamp").otherwise("string")
    )


def plain_number(number: Column, decimals: int = 4) -> Column:
    """A decimal in plain notation without trailing zeros, point or plus sign; zero has no sign."""
    text = F.round(number, decimals).cast("string")
    short = F.rtrim(F.rtrim(text, F.lit("0")), F.lit(".")) if decimals > 0 else text
    return F.when(F.round(number, decimals) == 0, "0").otherwise(short)


def plain_double(number: Column, decimals: int | None = None) -> Column:
    """A finite double in plain notation, rounded to ``decimals`` or with all that its shortest text has; very small ones keep their exponent then."""
    huge = F.when(number.isNotNull(), F.format_string("%.0f", number))
    if decimals is not None:
        return F.when(F.abs(number) < 1e27, plain_number(number.cast("string").try_cast(NUMBER), decimals)).otherwise(huge)
    text = number.cast("string")
    return F.when(number == 0, "0").when((number == F.floor(number)) & (F.abs(number) < 1e18), number.cast("long").cast("string")).when(F.abs(number) >= 1e18, huge).otherwise(text)


def whole_number(text: Column, number: Column) -> Column:
    """The digits of a whole number: of ``text`` where it is written in digits, else of the double ``number`` below 1e38; null if it isn't whole."""
    digits = F.regexp_replace(F.regexp_replace(text, r"^\+|\.0*$", ""), r"^(-?)0+(?=\d)", "$1")
    written = F.when(digits == "-0", "0").otherwise(digits)
    return F.when(text.rlike(r"\A[+-]?\d+(?:\.0*)?\z"), written).when((number == F.floor(number)) & (F.abs(number) < 1e38), number.cast("decimal(38,0)").cast("string"))


def number_text(text: Column) -> Column:
    """One spelling of a number however written: digits if it is whole, else the text of its double; other text is marked as such."""
    number = F.when(text.rlike(NUMERAL), text.try_cast("double"))
    return F.coalesce(whole_number(text, number), F.when(F.abs(number) < float("inf"), number.cast("string")), F.concat(F.lit("text:"), text))


def widest(names: list[str]) -> str:
    return reduce(lambda a, b: promote({a, b}), names)
