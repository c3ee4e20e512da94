"""Functions of the MySQL-flavoured dialect as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strftime-like signs of the dialect and Spark's pattern letters.
PATTERNS = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%c": "M", "%d": "dd", "%e": "d", "%H": "HH", "%h": "hh", "%I": "hh", "%i": "mm",
    "%s": "ss", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%M": "MMMM", "%b": "MMM", "%W": "EEEE", "%a": "EEE", "%j": "DDD", "%T": "HH:mm:ss", "%%": "%",
}


def spark_pattern(pattern: str) -> str:
    """A dialect date pattern in Spark's letters; other letters are quoted."""
    return "".join(PATTERNS[p] if p in PATTERNS else re.sub(r"[A-Za-z]+", r"'\g<0>'", p) for p in re.findall(r"%.|[^%]+", pattern))


def date_format(x: Column, pattern: str) -> Column:
    return F.date_format(x, spark_pattern(pattern))


def date_shift(x: Column, n: Column | int, unit: str) -> Column:
    """DATE_ADD(x, INTERVAL n unit); a negative n is DATE_SUB. Keeps the time of day."""
    n = n if isinstance(n, Column) else F.lit(n)
    names = {"YEAR": "years", "MONTH": "months", "WEEK": "weeks", "DAY": "days", "HOUR": "hours", "MINUTE": "mins", "SECOND": "secs"}
    return x + F.make_interval(**{names[unit.upper()]: n})


def divide(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def mod(a: Column, b: Column) -> Column:
    return F.try_mod(a, b)


def substring(x: Column, start: int, size: int | None = None) -> Column:
    """From 1, or from the end where negative; 0 gives the empty text."""
    if start == 0:
        return F.when(x.isNotNull(), F.lit(""))
    return F.substring(x, start, 2**31 - 1 if size is None else size)


def length(x: Column) -> Column:
    """Bytes; char_length counts characters."""
    return F.octet_length(x)


def group_concat(x: Column, separator: str = ",", distinct: bool = False) -> Column:
    """The group's values in order, joined."""
    return F.array_join(F.sort_array(F.collect_set(x) if distinct else F.collect_list(x)), separator)


def shard(key: Column, shards: int) -> Column:
    """The shard of an integer key."""
    return F.pmod(key, F.lit(shards))
