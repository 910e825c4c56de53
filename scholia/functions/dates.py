"""Year extraction rules for item dates and book records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INT = r"^[+-]?[0-9]+$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def year_of(col, min_len: int = 5) -> Column:
    """Integer of the first four characters when the string is long enough.

    ``min_len=5`` is the item rule (a bare ``'1980'`` gives NULL); ``min_len=4``
    is the lenient variant.  The four characters must be an optionally signed
    integer (no blanks), otherwise NULL.
    """
    s = _c(col)
    head = F.substring(s, 1, 4)
    ok = (F.length(s) >= F.lit(min_len)) & head.rlike(_INT)
    return F.when(ok, head.try_cast("int")).cast("int")


def book_year(raw, on_error: str = "zero") -> Column:
    """Year of the first ``dddd-dd-dd`` found anywhere in the raw JSON text.

    Without such a date the result is 0 (``on_error='zero'``, the stored
    behaviour) or NULL (``on_error='null'``).
    """
    found = F.regexp_extract(_c(raw), r"[0-9]{4}-[0-9]{2}-[0-9]{2}", 0)
    y = F.when(found != F.lit(""), F.substring(found, 1, 4).try_cast("int"))
    if on_error == "zero":
        return F.coalesce(y, F.lit(0)).cast("int")
    if on_error == "null":
        return y.cast("int")
    raise ValueError("on_error must be 'zero' or 'null'")
