"""Small column functions that Spark lacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB")


def human_size(n: Column) -> Column:
    """Bytes as text in steps of 1024 with two decimals, ``B`` to ``TB``; null stays null."""
    out = F.format_string(f"%.2f {UNITS[-1]}", n / float(1024 ** (len(UNITS) - 1)))
    for k in range(len(UNITS) - 2, -1, -1):
        out = F.when(n < float(1024 ** (k + 1)), F.format_string(f"%.2f {UNITS[k]}", n / float(1024**k))).otherwise(out)
    return F.when(n.isNotNull(), out)


def file_stem(path: Column, encoded: bool = True) -> Column:
    """File name without folder and last suffix. ``encoded``: the path is a URI's, whose percent escapes are read; a plus sign is one."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))) if encoded else path
    return F.regexp_replace(F.element_at(F.split(plain, "/"), -1), r"(?<=.)\.[^.]*$", "")


def file_key(path: Column, encoded: bool = True) -> Column:
    """File name up to its first dot: the key by which the same paper is known in several folders."""
    return F.element_at(F.split(file_stem(path, encoded), r"\."), 1)


def non_empty(c: Column) -> Column:
    """Null for the empty string."""
    return F.when(c != "", c)
