"""Identifiers as they lie in the tables, brought to one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space around an id.
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(col: Column | str) -> Column:
    """The text without white space around it."""
    return F.trim(F.col(col) if isinstance(col, str) else col, F.lit(WHITE_SPACE))


def run_id(col: Column | str) -> Column:
    """A run id: stripped, exact case; blank is null."""
    text = strip(col)
    return F.when(text != "", text)


def artifact_id(col: Column | str) -> Column:
    """An artifact id by value: lower case with dashes for a UUID in any spelling, else the stripped lower text; blank is null."""
    text = F.lower(strip(col))
    bare = F.translate(F.replace(text, F.lit("urn:uuid:"), F.lit("")), "{}-", "")
    dashed = F.concat_ws("-", *(F.substring(bare, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    # Most ids are plain already and meet only the first test.
    return F.when(text.rlike(r"\A[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\z"), text).when(bare.rlike(r"\A[0-9a-f]{32}\z"), dashed).when(text != "", text)
