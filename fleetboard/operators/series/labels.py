"""Positions of category labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ordered import GROUP_ROWS, in_order


def label_index(df: DataFrame, label: str, order: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Each distinct label with its 0-based place by first appearance in ``order``."""
    firsts = (
        df.filter(F.col(label).isNotNull())
        .groupBy(F.col(label).alias("label"))
        .agg(F.min(order).alias("first"))
    )
    return in_order(firsts, [], ["first", "label"], group_rows).number("index").rows()


def label_positions(
    points: DataFrame, labels: DataFrame, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """``position`` of each point (``label``, ``i``) on the axis ``labels``
    (``label``, ``i``; ``i`` is 0-based).

    A label listed once is at its own place; one listed more than once leaves the
    point at its own ``i``.  Text that is not listed follows after the last place,
    by first appearance; a number that is not listed stays at its own ``i``, at
    most the last place.  NULL has no position.
    """
    listed = labels.groupBy("label").agg(F.min("i").alias("_at"), F.count("*").alias("_n"))
    size = labels.count()
    # From here on labels are one row each, so a label that most points share
    # meets one row in the join below.
    firsts = points.groupBy("label").agg(F.min("i").alias("i"))
    new = firsts.join(listed, "label", "left_anti")
    if isinstance(points.schema["label"].dataType, T.NumericType):
        at, listings = F.lit(size - 1), 0
    else:
        new = label_index(new, "label", "i", group_rows)
        at, listings = F.col("index") + size, 1
    added = new.select(
        "label", at.cast("bigint").alias("_at"), F.lit(listings).cast("bigint").alias("_n")
    )
    places = listed.unionByName(added)
    position = (
        F.when(F.col("_n") > 1, F.col("i"))
        .when(F.col("_n") == 0, F.least("i", "_at"))
        .otherwise(F.col("_at"))
    )
    return points.join(places, "label", "left").withColumn("position", position).drop("_at", "_n")
