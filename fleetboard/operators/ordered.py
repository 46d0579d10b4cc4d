"""Row numbers, neighbours and running sums along an order, for groups of any size.

A window over ``partitionBy(key)`` brings a whole group to one task.  That is
fine while groups are small, and the first step here counts them.  When the
largest group has more than ``group_rows`` rows, the frame is instead dealt out by
contiguous ranges of (keys, order), which split inside a key as readily as
between keys.  The ranges' bounds are quantiles of a sample drawn by a hash of
the rows, so every step, retry and lost executor sees the same ones, and rows
are neither written down nor shuffled more than once.  Windows run inside a
range.  What has to cross from one range to the next is a summary of the two keys
at its ends, as any other key lies whole inside: two rows per range, whose
summaries are added up along the ranges of a key and broadcast.

``order`` must end in a column that makes rows of a key distinct; then a range
boundary can fall between any two rows, and results are the same on every run.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fleetboard.session import checkpoint

GROUP_ROWS = 1_000_000
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20  # of the same rows as text, keys included

RANGES = 4  # ranges per partition
PER_RANGE = 32  # rows of the sample per range

_RANGE = "_range"
_BEFORE = (Window.unboundedPreceding, -1)
_WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


def match_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which a NULL key matches NULL; keys are kept once."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def attach(
    df: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    limit: int = BROADCAST_ROWS,
    how: str = "inner",
) -> DataFrame:
    """Add per-key values to every row, without a window over the rows.

    ``per_key`` has one row per key and is usually tiny, but a planner that only
    sees an aggregate over everything would shuffle all rows to meet it.  So it
    is computed first and measured: up to ``limit`` rows and ``BROADCAST_BYTES`` of
    text it is broadcast and the rows stay where they are; beyond, the rows are
    shuffled by key, and skew handling cuts a hot key into pieces that each meet
    its one row.  ``how="left"`` keeps rows whose key has no values.
    """
    if not keys:
        one = per_key.first()
        types = {f.name: f.dataType for f in per_key.schema.fields}
        return df.withColumns({c: F.lit(one[c]).cast(t) for c, t in types.items()})
    ready = checkpoint(per_key)
    size = F.sum(F.octet_length(F.to_json(F.struct(*ready.columns))))
    rows, size = ready.limit(limit + 1).agg(F.count("*"), size).first()
    small = rows <= limit and (size or 0) <= BROADCAST_BYTES
    return match_keys(df, F.broadcast(ready) if small else ready, keys, how)


@dataclass(frozen=True)
class Ordered:
    """A frame with the order of its rows inside each key.  ``split`` says whether
    it was dealt out by ranges, in which case ``_range`` is set."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool

    def _window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, *([_RANGE] if self.split else [])).orderBy(*self.order)

    def _place(self) -> Column:
        """What rows of a key are ordered by, as one value."""
        return F.struct(*self.order)

    def _carry(self, per_range: Sequence[Column], across: Callable[[WindowSpec], Mapping[str, Column]]) -> DataFrame:
        """For the first and the last key of each range: ``per_range`` aggregates, then
        ``across`` windows over the ranges of a key.  Two rows per range at most."""
        # All columns take part, so that this reads the very shuffle that the rows come from.
        touched = F.max(F.hash(*[c for c, t in self.df.dtypes if "map<" not in t and t != "variant"])).alias("_touched")
        edges = self.df.groupBy(*self.keys, _RANGE).agg(*per_range, touched)
        if self.keys:
            row = F.struct(*self.keys, *[c for c in edges.columns if c not in (*self.keys, _RANGE)])
            ends = F.array_distinct(F.array(F.min(row), F.max(row)))
            edges = edges.groupBy(_RANGE).agg(ends.alias("_ends")).select(_RANGE, F.inline("_ends"))
        ranges = Window.partitionBy(*self.keys).orderBy(_RANGE)
        return edges.select(*self.keys, _RANGE, *[c.alias(n) for n, c in across(ranges).items()])

    def _met(self, inside: DataFrame, carry: DataFrame) -> DataFrame:
        """Rows with what their range was handed; a key whole inside a range is handed nothing."""
        return match_keys(inside, F.broadcast(carry), [*self.keys, _RANGE], "left")

    def _next(self, df: DataFrame, *drop: str) -> Ordered:
        return Ordered(df.drop(*drop), self.keys, self.order, self.split)

    def number(self, name: str) -> Ordered:
        """0-based place of each row in its key."""
        inside = self.df.withColumn(name, F.row_number().over(self._window()).cast("bigint") - 1)
        if not self.split:
            return self._next(inside)
        carry = self._carry([F.count("*").alias("_n")], lambda r: {"_base": F.sum("_n").over(r.rowsBetween(*_BEFORE))})
        joined = self._met(inside, carry)
        return self._next(joined.withColumn(name, F.col(name) + F.coalesce("_base", F.lit(0))), "_base")

    def total(self, name: str) -> Ordered:
        """The number of rows of each row's key."""
        w = Window.partitionBy(*self.keys, *([_RANGE] if self.split else []))
        inside = self.df.withColumn(name, F.count("*").over(w))
        if not self.split:
            return self._next(inside)
        carry = self._carry(
            [F.count("*").alias("_n")], lambda r: {"_all": F.sum("_n").over(r.rowsBetween(*_WHOLE))}
        )
        return self._next(self._met(inside, carry).withColumn(name, F.coalesce("_all", name)), "_all")

    def neighbour(self, names: Mapping[str, str], back: bool = True) -> Ordered:
        """Columns of the previous (or next) row of the key under new names, and
        NULL at its end."""
        step = F.lag if back else F.lead
        w = self._window()
        if not self.split:
            found = [step(c).over(w).alias(n) for n, c in names.items()]
            return self._next(self.df.select("*", *found))
        row = F.struct(*[F.col(c).alias(n) for n, c in names.items()])
        edge = (F.max_by if back else F.min_by)(row, self._place()).alias("_edge")
        carry = self._carry([edge], lambda r: {"_carried": step("_edge").over(r)})
        joined = self._met(self.df.withColumn("_inside", step(row).over(w)), carry)
        # _inside is NULL only for the row at the edge of its range.
        found = F.coalesce("_inside", "_carried")
        return self._next(
            joined.select("*", *[found[n].alias(n) for n in names]), "_inside", "_carried"
        )

    def running_sum(self, name: str, value: Column) -> Ordered:
        """Sum of ``value`` from the first row of the key up to this one."""
        w = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        inside = self.df.withColumn(name, F.sum(value).over(w))
        if not self.split:
            return self._next(inside)
        carry = self._carry([F.sum(value).alias("_s")], lambda r: {"_before": F.sum("_s").over(r.rowsBetween(*_BEFORE))})
        joined = self._met(inside, carry)
        total = (
            F.when(F.col("_before").isNull(), F.col(name))
            .when(F.col(name).isNull(), F.col("_before"))
            .otherwise(F.col("_before") + F.col(name))
        )
        return self._next(joined.withColumn(name, total), "_before")

    def last_known(self, name: str, value: Column, back: bool = True) -> Ordered:
        """The nearest non-NULL ``value`` at or before (or at or after) each row."""
        pick = F.last if back else F.first
        lo, hi = Window.unboundedPreceding, Window.currentRow
        if not back:
            lo, hi = Window.currentRow, Window.unboundedFollowing
        inside = self.df.withColumn(name, pick(value, ignorenulls=True).over(self._window().rowsBetween(lo, hi)))
        if not self.split:
            return self._next(inside)
        place = F.when(value.isNotNull(), self._place())
        edge = (F.max_by if back else F.min_by)(value, place).alias("_edge")
        span = _BEFORE if back else (1, Window.unboundedFollowing)
        carry = self._carry([edge], lambda r: {"_carried": pick("_edge", ignorenulls=True).over(r.rowsBetween(*span))})
        joined = self._met(inside, carry)
        return self._next(joined.withColumn(name, F.coalesce(name, "_carried")), "_carried")

    def first_known(self, name: str, value: Column) -> Ordered:
        """The first non-NULL ``value`` of the key up to each row."""
        w = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        inside = self.df.withColumn(name, F.first(value, ignorenulls=True).over(w))
        if not self.split:
            return self._next(inside)
        edge = F.min_by(value, F.when(value.isNotNull(), self._place())).alias("_edge")
        carry = self._carry([edge], lambda r: {"_carried": F.first("_edge", ignorenulls=True).over(r.rowsBetween(*_BEFORE))})
        joined = self._met(inside, carry)
        return self._next(joined.withColumn(name, F.coalesce("_carried", name)), "_carried")

    def distinct(self) -> Ordered:
        """Rows once; equal rows are always in one range."""
        return self._next(self.df.dropDuplicates())

    def rows(self) -> DataFrame:
        return self.df.drop(_RANGE)


def _range_of(df: DataFrame, columns: Sequence[str], ranges: int, total: int) -> DataFrame:
    """Add ``_range``: in which of about ``ranges`` contiguous ranges of ``columns``, of
    about equal numbers of rows, a row lies.

    Bounds are quantiles of ``PER_RANGE`` rows per range, chosen by a hash of their
    values.  They are a scalar of the plan, worked out once where they are used.
    """
    place = F.struct(*columns)
    share = min(1.0, PER_RANGE * ranges / max(total, 1))
    chosen = F.shiftrightunsigned(F.xxhash64(*columns, F.lit(20250611)), 33) < int(share * 2**31)
    sample = df.where(chosen).agg(F.array_sort(F.collect_list(place)).alias("s"))
    every = F.filter("s", lambda _, i: i % PER_RANGE == PER_RANGE - 1)
    bounds = F.col("_bounds")
    # Bisection: steps of falling powers of two, each taken if the bound there is not above the row.
    steps = [1 << k for k in reversed(range((2 * ranges).bit_length()))]

    def halve(at: Column, step: Column) -> Column:
        return F.when(place >= F.get(bounds, at + step - 1), at + step).otherwise(at)

    bound = df.withColumn("_bounds", sample.select(F.array_distinct(every)).scalar())
    return bound.withColumn(_RANGE, F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), halve)).drop("_bounds")


def in_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], group_rows: int = GROUP_ROWS, largest: int | None = None
) -> Ordered:
    """Rows of ``df`` in ``order``, ascending with NULL first, inside each key, ready
    for ordered operators.  ``largest`` may name a known bound on the rows of a key
    and saves the count if it is small."""
    total = 0
    if largest is None or largest > group_rows:
        sizes = df.groupBy(*keys).count() if keys else df.agg(F.count("*").alias("count"))
        found = sizes.agg(F.max("count").alias("largest"), F.sum("count").alias("total")).first()
        largest, total = found["largest"] or 0, found["total"] or 0
    if largest <= group_rows:
        return Ordered(df, tuple(keys), tuple(order), split=False)
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(default, -(-total // group_rows))
    # Several ranges a partition, as ranges fall on partitions by hash.
    ranged = _range_of(df, [*keys, *order], RANGES * parts, total).repartition(parts, _RANGE)
    return Ordered(ranged, tuple(keys), tuple(order), split=True)
