"""Small relational building blocks of the reports.

Sizes: a fact is always reduced by key before it meets a dimension, so a join
sees each key once however many trips it has.  No join is forced to broadcast
unless its small side has a bound fixed by its own meaning (24 hours); the rest
is left to the optimizer, which checks sizes against
``spark.sql.autoBroadcastJoinThreshold`` at planning and again at run time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from fleetboard.functions import percent

# A long is cut into parts of this many bits; sums of 2**42 rows of a part fit a long.
_PART_BITS = 21


def per_key(df: DataFrame, key: str, *aggs: Column) -> DataFrame:
    """One row per key, added up inside each partition before the shuffle, so a
    key that holds most of the rows still travels as one row per partition."""
    return df.groupBy(key).agg(*aggs)


PARTS = ("high", "mid", "low")


def exact_parts(df: DataFrame, amount: str) -> dict[str, Column]:
    """Aggregates which together are the exact sum of a decimal column (up to 18 digits).

    A decimal sum adds big numbers object by object.  Here the amount is counted
    in its smallest unit and cut into three whole numbers of 21 bits, so the adding
    up is plain long arithmetic, which 4 * 10**12 rows of a key cannot overflow.
    Parts of several groups add up to those of their union.
    """
    dtype = df.schema[amount].dataType
    if not isinstance(dtype, DecimalType) or dtype.precision > 18:
        raise TypeError(f"{amount} must be a decimal of up to 18 digits, not {dtype.simpleString()}")
    whole = (F.col(amount) * 10**dtype.scale).cast("bigint")
    mask = F.lit(2**_PART_BITS - 1).cast("bigint")
    return {
        "high": F.sum(F.shiftright(whole, 2 * _PART_BITS)),
        "mid": F.sum(F.shiftright(whole, _PART_BITS).bitwiseAND(mask)),
        "low": F.sum(whole.bitwiseAND(mask)),
    }


def exact_total(parts: Mapping[str, Column], dtype: DecimalType) -> Column:
    """The decimal that the parts of a sum make together."""
    high, mid, low = (parts[p].cast("decimal(20,0)") for p in PARTS)
    return ((high * 2**_PART_BITS + mid) * 2**_PART_BITS + low) * F.lit(Decimal(1).scaleb(-dtype.scale))


def sum_exact(df: DataFrame, keys: Sequence[str | Column], amount: str, name: str) -> DataFrame:
    """Exact sum of a decimal column per key, put together once per key."""
    parts = df.groupBy(*keys).agg(*[c.alias(f"_{p}") for p, c in exact_parts(df, amount).items()])
    total = exact_total({p: F.col(f"_{p}") for p in PARTS}, df.schema[amount].dataType)
    return parts.withColumn(name, total).drop(*[f"_{p}" for p in PARTS])


def with_dimension(facts: DataFrame, dimension: DataFrame, key: str, *columns: str) -> DataFrame:
    """Inner equi-join of per-key facts to the columns asked for."""
    return facts.join(dimension.select(key, *columns), key, "inner")


def top_k(df: DataFrame, order: Sequence[Column], k: int | None = None) -> DataFrame:
    """Rows in order, the first ``k`` if given.  End ``order`` in a unique column
    so that ties fall the same way on every run."""
    ordered = df.orderBy(*order)
    return ordered if k is None else ordered.limit(k)


def measures_to_rows(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """A one-row result turned into one row per measure under fixed labels."""
    rows = [F.struct(F.lit(text).alias("label"), F.col(c).alias("value")) for c, text in labels.items()]
    return df.select(F.inline(F.array(*rows)))


def conditional_counts(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Rows meeting each condition, all counted in one pass; label and count."""
    names = {f"c{i}": text for i, text in enumerate(conditions)}
    counts = [F.count_if(cond).alias(f"c{i}") for i, cond in enumerate(conditions.values())]
    return measures_to_rows(df.agg(*counts), names)


def flag_rates(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Percent of ones per 0/1 column over its non-NULL rows, one decimal."""
    rates = [percent(F.sum(c), F.count(c)).alias(c) for c in labels]
    return measures_to_rows(df.agg(*rates), labels)


def two_slots(df: DataFrame, column: str, one: str, other: str) -> DataFrame:
    """Count of rows equal to 1 and of all the others, NULL included."""
    is_one = F.coalesce(F.col(column) == 1, F.lit(False))
    return conditional_counts(df, {one: is_one, other: ~is_one})


def zero_fill(spine: DataFrame, counts: DataFrame, key: str, value: str) -> DataFrame:
    """Every row of the spine, with 0 where ``counts`` has no such key."""
    filled = spine.join(counts, key, "left")
    return filled.withColumn(value, F.coalesce(F.col(value), F.lit(0).cast("bigint")))


def every_hour(counts: DataFrame) -> DataFrame:
    """``counts`` (hour, value) with all 24 hours of a day, 0 where there is none."""
    spine = counts.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    # hour() can only give 24 values, so this side has 24 rows at most.
    return zero_fill(spine, F.broadcast(counts), "hour", "value")


def hourly_counts(df: DataFrame, ts: str) -> DataFrame:
    """Rows per hour of day for all 24 hours."""
    counts = (
        df.filter(F.col(ts).isNotNull())
        .groupBy(F.hour(ts).alias("hour"))
        .agg(F.count("*").alias("value"))
    )
    return every_hour(counts)


def detail_and_total(detail: DataFrame, key: str, sums: Sequence[str]) -> DataFrame:
    """Per-key sums, then one row (NULL key, ``is_total``) with the sums over all.

    The total is added up from the per-key rows, so the facts are read once: both
    branches use the same shuffle.  It is there for empty input too.
    """
    keyed = detail.select(key, *sums, F.lit(False).alias("is_total"))
    total = detail.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]).select(
        F.lit(None).cast(detail.schema[key].dataType).alias(key),
        *sums,
        F.lit(True).alias("is_total"),
    )
    return keyed.unionByName(total)
