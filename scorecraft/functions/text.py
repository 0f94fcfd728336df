"""String helpers that keep the work in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_strip(c: Column) -> Column:
    """Whitespace strip on both ends as Python does it, Unicode blanks and the
    separators U+001C..U+001F included (Spark's ``trim`` removes only spaces)."""
    blank = r"[\s\x1c-\x1f\x85\p{Z}]+"
    return F.regexp_replace(c, f"^{blank}|{blank}$", "")


def norm_label(c: Column) -> Column:
    """Labels compare case- and whitespace-insensitively."""
    return F.lower(py_strip(c))


def ascii_fold(c: Column) -> Column:
    """Drop non-ASCII characters (used where another engine counts bytes)."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")
