"""Scalar column functions: names and keys, times, ratios, draws, geometry."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Two-sided 95 % t quantiles for 1 to 9 degrees of freedom.
T95 = {1: 12.71, 2: 4.30, 3: 3.18, 4: 2.78, 5: 2.57, 6: 2.45, 7: 2.36, 8: 2.31, 9: 2.26}


def basename(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The base name without its last suffix."""
    return F.regexp_replace(basename(path), r"(.)\.[^.]*$", "$1")


def suffix(path: Column) -> Column:
    """The last suffix with its dot, lower case; empty if none."""
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]*)$", 1))


def strip_serial(name: Column) -> Column:
    """Drops a leading five-digit serial and underscore, if there is one."""
    return F.regexp_replace(name, r"^[0-9]{5}_", "")


def run_parts(name: Column) -> Column:
    """(tag, cfg, seed) of names like tag_cfg_parts_s3; null for other names."""
    parts = F.split(name, "_")
    n = F.size(parts)
    fits = (n >= 3) & F.element_at(parts, -1).rlike("^s[0-9]+$")
    made = F.struct(F.element_at(parts, 1).alias("tag"), F.array_join(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(1))), "_").alias("cfg"), F.substring(F.element_at(parts, -1), 2, 9).cast("int").alias("seed"))
    return F.when(fits, made)


def minutes(seconds: Column) -> Column:
    """m:ss; minutes are not padded."""
    whole = F.floor(seconds).cast("long")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def ratio_or_zero(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def ratio_or_null(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0, so that averages leave it out."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def draw(key: Column, seed: int | str) -> Column:
    """32 pseudo-random bits of a key, the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("long")


def t_critical(df: Column, fallback: float) -> Column:
    """T95 by degrees of freedom; `fallback` beyond the table, 0 below 1."""
    out = F.when(df < 1, F.lit(0.0))
    for k, t in T95.items():
        out = out.when(df == k, F.lit(t))
    return out.otherwise(F.lit(float(fallback)))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two longs differ."""
    return F.bit_count(a.bitwiseXOR(b))


def overlay(given: Column, defaults: dict[str, Column]) -> list[Column]:
    """Fields of a struct column, each with its default where null."""
    return [F.coalesce(given.getField(k), v).alias(k) for k, v in defaults.items()]


def has_any(array: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(F.size(array), F.lit(0)) > 0


def wanted(key: Column, only: str | None) -> Column:
    """Whether key is in a comma list; all are if the list is None."""
    return F.lit(True) if only is None else F.array_contains(F.split(F.lit(only), ","), key)


@F.pandas_udf(StringType())
def nfc(names: pd.Series) -> pd.Series:
    """Unicode NFC, which Spark has no function for."""
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def corners_to_centre(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> list[Column]:
    """cx, cy, w, h as shares of the canvas."""
    return [((x0 + x1) / 2 / width).alias("cx"), ((y0 + y1) / 2 / height).alias("cy"), ((x1 - x0) / width).alias("w"), ((y1 - y0) / height).alias("h")]


def centre_to_corners(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """x0, y0, x1, y1 in canvas units."""
    return [((cx - w / 2) * width).alias("x0"), ((cy - h / 2) * height).alias("y0"), ((cx + w / 2) * width).alias("x1"), ((cy + h / 2) * height).alias("y1")]


def clamp_start(centre: Column, size: Column, room: Column) -> Column:
    """Where a box of a size starts inside a canvas: truncated toward zero, then kept within."""
    return F.least(F.greatest(F.lit(0), (centre - size / 2).cast("int")), F.greatest(F.lit(0), room - size))
