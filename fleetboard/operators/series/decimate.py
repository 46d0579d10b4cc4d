"""Fewer points that draw the same line.

Both operators keep whole points, never invented ones.

*Min-max* is aggregation of cells: each Arrow batch passes on four rows per series
and column, and only those are added up.  *Largest triangle* is sequential by nature: the
point kept in a bucket depends on the one kept before.  What makes it scale is
that, for fixed neighbours, the triangle's area is the absolute value of a linear
function of the candidate point, so its largest value is always at a corner of
the bucket's convex hull.  Each batch of rows therefore passes on only its hull
corners (the hull of a union is the hull of the hulls).  The chain of choices over
those few is cut into stretches that are worked out beside each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetboard.session import checkpoint

from ..ordered import GROUP_ROWS, attach, in_order, match_keys
from .cells import extremes
from .segments import range_slice
from .triangle import COLUMNS, chain_maps, choose, follow, hulls, hulls_and_sums


def min_max_decimate(points: DataFrame, width: int, threshold: int | None = None) -> DataFrame:
    """The first, lowest, highest and last point of each of ``width`` columns.

    The column that holds a series' largest ``x`` gives only its first point.
    Of equal values the earliest point is kept, and NaN counts as no value.  A series of up to ``threshold``
    points (four per column if not given) is returned whole.  Points keep their
    own ``x``.
    """
    limit = 4 * width if threshold is None else threshold
    points = points.select(*COLUMNS).filter(F.col("x").isNotNull())
    # NaN is no extreme; a point that has it can still be first or last.
    y = F.when(~F.isnan(F.col("y").cast("double")), F.col("y"))
    spans = points.groupBy("series").agg(
        F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.count("*").alias("_n")
    )
    span = F.col("_x1") - F.col("_x0")
    column = F.when(span == 0, 0).otherwise(F.floor((F.col("x") - F.col("_x0")) / span * width))
    placed = attach(points, spans, ["series"]).select(
        *COLUMNS,
        column.cast("int").alias("_col"),
        (F.col("x") == F.col("_x1")).alias("_at_end"),
        (F.col("_n") <= limit).alias("_whole"),
    )
    # Rows of a short series are cells of their own, equal ones together.
    own = F.when(F.col("_whole"), F.struct(*[c for c in COLUMNS if c != "series"]))
    cells = placed.select(*COLUMNS, F.when(~F.col("_whole"), F.col("_col")).alias("_col"), "_at_end", own.alias("_own"))
    reduced = cells.mapInArrow(extremes, _nullable(cells.schema.fields))

    # One aggregate of what batches left: four rows per cell and batch, not points.
    point = F.struct("x", "id", "y")
    kept = reduced.groupBy("series", "_col", "_own").agg(
        F.min(point).alias("first"),
        F.max(point).alias("last"),
        F.min_by(point, F.when(y.isNotNull(), F.struct("y", "x", "id"))).alias("low"),
        F.max_by(point, F.when(y.isNotNull(), F.struct("y", -F.col("x"), -F.col("id")))).alias("high"),
        F.max("_at_end").alias("_end"),
        F.count("*").cast("int").alias("_times"),
    )
    inside = F.array_distinct(F.array("first", "low", "high", "last"))
    all_of = (
        F.when(F.col("_own").isNotNull(), F.array_repeat("first", F.col("_times")))
        .when(F.col("_end"), F.array("first"))
        .otherwise(inside)
    )
    rows = kept.select("series", F.explode(all_of).alias("p")).filter(F.col("p").isNotNull())
    return rows.select("series", "p.x", "p.y", "p.id")


HULL_DEALS = 16  # tasks that share the corners of a bucket before they are merged


# -- largest triangle ---------------------------------------------------------------


def _bucket_start(bucket: Column, rate: Column) -> Column:
    return F.floor(bucket * rate) + 1


def _bucket(i: Column, rate: Column) -> Column:
    """The bucket of row ``i``: the last one that starts at or before it.  The
    quotient can be off by one in floating point, so its neighbours are tried."""
    guess = F.floor((i - 1) / rate)
    return (
        F.when(_bucket_start(guess + 1, rate) <= i, guess + 1)
        .when(_bucket_start(guess, rate) <= i, guess)
        .otherwise(guess - 1)
    )


def _nullable(fields: list[T.StructField]) -> T.StructType:
    """Rows of sums hold NULL where rows of points have values, also for columns
    that the caller's frame declares without NULLs."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])


def _merged(corners: DataFrame, *by: str) -> DataFrame:
    """Corners of what lies together under ``by``."""
    met = corners.repartition(*by).sortWithinPartitions("series", "bucket", "x", "id")
    return met.mapInArrow(hulls, _nullable(corners.schema.fields))


def lttb_decimate(
    points: DataFrame,
    width: int,
    samples: int | None = None,
    threshold: int | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Largest-triangle-three-buckets: exactly ``samples`` points per series
    (``width`` if not given), its first and last among them.

    A series of up to ``threshold`` points (four per unit of width if not given)
    or up to ``samples`` points is returned whole.  Points without a finite
    ``x`` or ``y`` are left out.  The last pass goes over a series' hull corners (on
    noisy data few per bucket, at worst, on a convex curve, every point of the
    series) in ``STRETCHES`` tasks.
    """
    samples = samples or width
    limit = max(4 * width if threshold is None else threshold, samples)
    # A comparison with infinity drops NULL; NaN compares as larger than it.
    finite = [F.abs(F.col(c).cast("double")) < float("inf") for c in ("x", "y")]
    points = points.select(*COLUMNS).filter(finite[0] & finite[1])
    placed = in_order(points, ["series"], ["x", "id"], group_rows).number("_i").total("_n").rows()

    # Bucket -2 is a series kept whole, -1 a first point, samples - 1 a last point.
    i, n = F.col("_i"), F.col("_n")
    inner = max(samples - 2, 0)
    rate = (n - 2) / F.lit(float(max(inner, 1)))
    bucket = (
        F.when(n <= limit, -2)
        .when(i == 0, -1)
        .when(i == n - 1, samples - 1)
        .otherwise(_bucket(i, rate) if inner else F.lit(None))
    )
    placed = placed.select(*COLUMNS, bucket.cast("int").alias("bucket"))
    if not inner:
        return placed.filter("bucket is not null").select(*COLUMNS)

    # One pass over the points.  What it leaves is small and used three times, so
    # it is written down.
    sums = "sx double, sy double, n bigint"
    reduced = _nullable(placed.schema.fields + T.StructType.fromDDL(sums).fields)
    left = checkpoint(placed.mapInArrow(hulls_and_sums(inner - 1), reduced))
    here = F.col("bucket")
    points = left.filter(F.col("n").isNull()).select(*COLUMNS, "bucket")
    kept = points.filter((here < 0) | (here == samples - 1)).select(*COLUMNS)

    # The mean of bucket b + 1 is what bucket b looks ahead to; the last point is
    # a bucket that is only looked at.
    means = (
        left.filter(F.col("n").isNotNull() & (here >= 1))
        .groupBy("series", (F.least(here, F.lit(inner)) - 1).alias("bucket"))
        .agg(
            (F.sum("sx") / F.sum("n")).alias("nx"),
            (F.sum("sy") / F.sum("n")).alias("ny"),
        )
    )
    # The corners of a bucket are brought together in two rounds, of which the first
    # deals those of a hot bucket over several tasks: the hull of hulls is the same.
    corners = points.filter((here >= 0) & (here < inner))
    dealt = corners.withColumn("_deal", F.pmod(F.hash("x", "id"), F.lit(HULL_DEALS)))
    corners = _merged(dealt, "series", "bucket", "_deal").drop("_deal")
    corners = checkpoint(_merged(corners, "series", "bucket"))
    first = points.filter(here == -1).withColumns({"stretch": F.lit(0), "nx": F.lit(0.0), "ny": F.lit(0.0)})
    return kept.unionByName(_chained(corners, first, means, max(1, -(-inner // STRETCHES))))


STRETCHES = 32  # parts of a series' chain that are worked out beside each other
CUT_AREAS = 4_000_000  # a chain is cut between buckets whose corners make no more triangles than this


def _chained(corners: DataFrame, first: DataFrame, means: DataFrame, size: int) -> DataFrame:
    """The corner chosen in every bucket.

    The choice in a bucket needs the one before it, so a chain is a sequence.  But a
    stretch of about ``size`` buckets is a map from the corner chosen before it to the
    one chosen last in it, and maps compose: all stretches work out theirs at once,
    one small pass per series follows them, and then every stretch knows where it
    begins and makes its choices.
    """
    by = Window.partitionBy("series").orderBy("bucket")
    counts = match_keys(means, corners.groupBy("series", "bucket").agg(F.count("*").alias("_c")), ["series", "bucket"], "left")
    pairs = F.col("_c") * F.lag("_c").over(by)
    cut = (F.col("bucket") > 0) & (F.col("bucket") % size == 0) & (pairs <= CUT_AREAS)
    # One row per bucket, at most ``samples`` of them for a series.
    table = counts.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int"))
    table = checkpoint(table.withColumn("stretch", F.sum("_cut").over(by).cast("int")))
    ahead = match_keys(corners, table.select("series", "bucket", "nx", "ny", "stretch"), ["series", "bucket"], "inner")
    # Corners from which a stretch may begin, beside their own.
    cuts = table.filter("_cut = 1").select("series", (F.col("bucket") - 1).alias("bucket"), "stretch")
    begins = match_keys(corners, cuts, ["series", "bucket"], "inner").withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0)})
    # What the last stretch of a series ends with is not asked for.
    last = table.groupBy("series").agg(F.max("stretch").alias("_last"))
    mapped = match_keys(ahead.unionByName(begins).unionByName(first), last, ["series"], "inner").filter("stretch < _last")

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.select(*COLUMNS, "bucket", "stretch", "nx", "ny").repartition("series", "stretch")
        return rows.sortWithinPartitions("series", "stretch", "bucket", "x", "id")

    def kind(name: str) -> T.DataType:
        return corners.schema[name].dataType

    ends = T.StructType([
        T.StructField("series", kind("series")), T.StructField("stretch", T.IntegerType()),
        T.StructField("from_x", kind("x")), T.StructField("from_id", kind("id")),
        *[T.StructField(c, kind(c)) for c in ("x", "y", "id")],
    ])
    starts = T.StructType([f for f in ends.fields if not f.name.startswith("from_")])
    maps = dealt(mapped).mapInArrow(chain_maps(to_arrow_schema(ends)), ends)
    followed = maps.repartition("series").sortWithinPartitions("series", "stretch").mapInArrow(follow(to_arrow_schema(starts)), starts)
    begun = followed.withColumns({"bucket": F.lit(-1), "nx": F.lit(0.0), "ny": F.lit(0.0)})
    rows = dealt(ahead.unionByName(begun, allowMissingColumns=True).unionByName(first))
    return rows.mapInArrow(choose, _nullable([corners.schema[c] for c in COLUMNS]))


def decimate_visible(
    points: DataFrame, lo, hi, width: int, threshold: int | None = None, samples: int | None = None, largest: bool = False
) -> DataFrame:
    """What is drawn of the range [lo, hi]: its points with their neighbours (see
    :func:`.segments.range_slice`), decimated as a line of their own.

    Whether a series is decimated, and into which columns or buckets, follows from
    the points of the slice alone, so the same width shows more of a narrower range.
    With ``largest`` by largest triangle into ``samples``, else by min-max.
    """
    # Read once more for each pass of the decimation, as small as it is next to the history.
    shown = checkpoint(range_slice(points.select(*COLUMNS), lo, hi))
    if largest:
        return lttb_decimate(shown, width, samples, threshold)
    return min_max_decimate(shown, width, threshold)
