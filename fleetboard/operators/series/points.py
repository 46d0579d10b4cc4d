"""Nested chart data to point rows, and per-point value rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def arrays_to_points(
    df: DataFrame, keys: Sequence[str], labels: str, values: str
) -> DataFrame:
    """Parallel arrays to rows ``i``, ``x``, ``y``; the shorter one is filled with NULL."""
    zipped = F.arrays_zip(F.col(labels).alias("x"), F.col(values).alias("y"))
    rows = df.select(*keys, F.posexplode(zipped).alias("i", "p"))
    return rows.select(*keys, "i", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def pairs_to_points(df: DataFrame, keys: Sequence[str], pairs: str) -> DataFrame:
    """An array of ``[x, y]`` or ``[x, y, size]`` to rows; missing parts are NULL."""
    rows = df.select(*keys, F.posexplode(pairs).alias("i", "p"))
    part = [F.try_element_at("p", F.lit(k)) for k in (1, 2, 3)]
    names = ("x", "y", "r")
    return rows.select(*keys, "i", *[c.alias(n) for c, n in zip(part, names)])


def objects_to_points(
    df: DataFrame,
    keys: Sequence[str],
    objects: str,
    x_key: str = "x",
    y_key: str = "y",
    r_key: str | None = None,
) -> DataFrame:
    """An array of structs to rows; a key may be a dotted path into a struct."""
    rows = df.select(*keys, F.posexplode(objects).alias("i", "p"))
    wanted = {"x": x_key, "y": y_key, **({"r": r_key} if r_key else {})}
    return rows.select(*keys, "i", *[F.col(f"p.{path}").alias(n) for n, path in wanted.items()])


def map_to_points(df: DataFrame, keys: Sequence[str], values: str) -> DataFrame:
    """A map to one row per entry, ``x`` the key and ``y`` the value."""
    return df.select(*keys, F.explode(values).alias("x", "y"))


def range_values(start: Column, end: Column) -> dict[str, Column]:
    """Columns of a floating value ``[start, end]``: its ``lo`` and ``hi``, the
    ``head`` further from zero and the ``base`` nearer to it.  At equal distance
    the head is the upper end."""
    lo, hi = F.least(start, end), F.greatest(start, end)
    down = F.abs(lo) > F.abs(hi)
    return {
        "lo": lo,
        "hi": hi,
        "base": F.when(down, hi).otherwise(lo),
        "head": F.when(down, lo).otherwise(hi),
    }


def positive_only(value: Column) -> Column:
    """The value if it can be shown on a logarithmic axis, else NULL."""
    return F.when((value > 0) & ~F.isnan(value) & (value < float("inf")), value)
