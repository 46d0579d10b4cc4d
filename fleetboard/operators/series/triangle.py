"""What runs inside tasks for largest-triangle decimation: numpy over Arrow batches."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

COLUMNS = ["series", "x", "y", "id"]

# Sent along with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _chain(x: np.ndarray, y: np.ndarray, group: np.ndarray, rounds: int = 64) -> np.ndarray:
    """Positions left of the upper chain.  ``x`` rises strictly inside a group.

    A point on or under the line between its two neighbours is no corner.  All
    such points leave at once, until none does; stopping early only leaves more.
    """
    at = np.arange(len(x))
    for _ in range(rounds):
        if len(at) < 3:
            break
        a, b, c = at[:-2], at[1:-1], at[2:]
        inner = (group[a] == group[b]) & (group[b] == group[c])
        turn = (x[c] - x[a]) * (y[b] - y[a]) - (y[c] - y[a]) * (x[b] - x[a])
        out = inner & (turn <= 0)
        if not out.any():
            break
        at = np.delete(at, np.flatnonzero(out) + 1)
    return at


def _codes(column: pa.Array) -> np.ndarray:
    """A small integer per distinct value; NULL is a value of its own."""
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy()


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it; true for the first row."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _corners(group: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Which rows can be chosen: per group the hull corners, and the first row,
    which wins when all triangles are empty.  Rows come sorted by group and x."""
    keep = _changes(group)
    rel = (xs - xs.min()).astype("float64")
    for sign in (1.0, -1.0):
        side = sign * ys
        # One row per x: the outermost, and of equals the earliest.
        outer = np.lexsort((np.arange(len(xs)), -side, xs, group))
        outer = outer[_changes(group[outer], xs[outer])]
        keep[outer[_chain(rel[outer], side[outer], group[outer])]] = True
    return keep


def _sorted(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """The batch by series, bucket, x, id, and a number per (series, bucket)."""
    codes = _codes(batch["series"])
    bucket, xs, ids = (batch[c].to_numpy() for c in ("bucket", "x", "id"))
    order = np.lexsort((ids, xs, bucket, codes))
    return batch.take(pa.array(order)), np.cumsum(_changes(codes[order], bucket[order]))


def hulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Only the corner rows."""
    for batch in batches:
        if batch.num_rows:
            batch, group = _sorted(batch)
            keep = _corners(group, batch["x"].to_numpy(), batch["y"].to_numpy())
            yield batch.filter(pa.array(keep))


def hulls_and_sums(last: int):
    """Corner rows of buckets 0 to ``last`` with all rows of other buckets, and
    one row of sums (``n`` set, point columns NULL) per bucket from 0 on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            batch, group = _sorted(batch)
            bucket, xs, ys = (batch[c].to_numpy() for c in ("bucket", "x", "y"))
            keep = _corners(group, xs, ys) | (bucket < 0) | (bucket > last)
            starts = np.flatnonzero(_changes(group))
            counts = np.diff([*starts, len(group)])
            inner = bucket[starts] >= 0
            sums = {
                "sx": pa.array(np.add.reduceat(xs.astype("float64"), starts)[inner]),
                "sy": pa.array(np.add.reduceat(ys, starts)[inner]),
                "n": pa.array(counts[inner].astype("int64")),
            }
            points = batch.filter(pa.array(keep))
            heads = batch.take(pa.array(starts[inner]))
            of_points = {c: points[c] for c in points.schema.names}
            of_sums = {
                c: heads[c] if c in ("series", "bucket") else pa.nulls(len(heads), heads[c].type)
                for c in heads.schema.names
            }
            for name, column in sums.items():
                of_points[name] = pa.nulls(points.num_rows, column.type)
                of_sums[name] = column
            yield pa.RecordBatch.from_pydict(of_points)
            yield pa.RecordBatch.from_pydict(of_sums)

    return run


def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per bucket, in one pass over rows sorted by series, bucket, x, id.

    Bucket -1 is the first point of a series, which is kept elsewhere and only
    starts the chain.  ``nx`` and ``ny`` are the mean of the next bucket.
    Nothing is held between batches but the best row of the open bucket.
    """
    series, bucket = None, None
    px, py = 0.0, 0.0
    area, best = -1.0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        schema = pa.schema([batch.schema.field(c) for c in COLUMNS])
        buckets, x, y, nx, ny = (batch[c].to_numpy(zero_copy_only=False) for c in
                                 ("bucket", "x", "y", "nx", "ny"))
        starts = np.flatnonzero(_changes(_codes(batch["series"]), buckets))
        done = []
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
            name = batch["series"][int(lo)].as_py()
            if bucket is None or name != series or buckets[lo] != bucket:
                if best is not None:
                    done.append(best)
                    px, py = float(best["x"]), float(best["y"])
                series, bucket = name, buckets[lo]
                area, best = -1.0, None
            if bucket < 0:
                px, py = float(x[lo]), float(y[lo])
                continue
            run = slice(lo, hi)
            size = 0.5 * np.abs((px - nx[run]) * (y[run] - py) - (px - x[run]) * (ny[run] - py))
            at = int(np.argmax(size))
            if size[at] > area:
                area = size[at]
                best = {c: batch[c][int(lo) + at].as_py() for c in COLUMNS}
        yield pa.RecordBatch.from_pylist(done, schema=schema)
    if best is not None:
        yield pa.RecordBatch.from_pylist([best], schema=schema)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, dict[str, np.ndarray]]]:
    """((series, stretch), bucket, columns) of rows sorted by these, a whole bucket at a time."""
    names = ("x", "y", "id", "nx", "ny")
    open_, held = None, []

    def whole() -> dict[str, np.ndarray]:
        return {n: np.concatenate([h[n] for h in held]) for n in names}

    for batch in batches:
        if not batch.num_rows:
            continue
        buckets, stretches = (batch[c].to_numpy() for c in ("bucket", "stretch"))
        columns = {n: batch[n].to_numpy(zero_copy_only=False) for n in names}
        starts = np.flatnonzero(_changes(_codes(batch["series"]), stretches, buckets))
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
            key = ((batch["series"][int(lo)].as_py(), int(stretches[lo])), int(buckets[lo]))
            if open_ is not None and key != open_:
                yield *open_, whole()
                held = []
            open_ = key
            held.append({n: c[lo:hi] for n, c in columns.items()})
    if open_ is not None:
        yield *open_, whole()


AREAS = 1_000_000  # triangles worked out at once


def _next_corner(px: np.ndarray, py: np.ndarray, rows: dict[str, np.ndarray]) -> np.ndarray:
    """For each point chosen before, which row of a bucket makes the largest triangle."""
    x, y, nx, ny = (rows[c][None, :] for c in ("x", "y", "nx", "ny"))
    step = max(1, AREAS // x.shape[1])
    found = []
    for lo in range(0, len(px), step):
        ax, ay = px[lo : lo + step, None], py[lo : lo + step, None]
        found.append(np.argmax(0.5 * np.abs((ax - nx) * (y - ay) - (ax - x) * (ny - ay)), axis=1))
    return np.concatenate(found)


def chain_maps(schema: pa.Schema):
    """Per stretch of buckets which corner is chosen last, for every corner that may
    have been chosen before it.

    The first bucket of a stretch's rows holds the corners before it.  Different
    beginnings soon choose the same corner and are one from there on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, start, now, at = None, {}, {}, np.zeros(0, dtype=np.int64)

        def ends() -> pa.RecordBatch:
            n = len(start["x"])
            columns = [[group[0]] * n, [group[1]] * n, *[start[c] for c in ("x", "id")], *[now[c][at] for c in ("x", "y", "id")]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)

        for key, _, rows in _parts(batches):
            if key != group:
                if group is not None:
                    yield ends()
                # Of the corners chosen so far: where they are in ``now``, per beginning.
                group, start, now, at = key, rows, rows, np.arange(len(rows["x"]))
                continue
            states, of = np.unique(at, return_inverse=True)
            best = _next_corner(now["x"][states].astype("float64"), now["y"][states], rows)
            now, at = rows, best[of]
        if group is not None:
            yield ends()

    return run


def follow(schema: pa.Schema):
    """The corner each stretch but the first begins with, from the maps of a series in
    order of their stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, done, point = None, None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if series is None or row["series"] != series[0]:
                    series, done, point = (row["series"],), None, None
                if row["stretch"] == done:
                    continue
                # The first stretch begins at the series' first point, which is its only beginning.
                if point is None or (row["from_x"], row["from_id"]) == (point["x"], point["id"]):
                    done, point = row["stretch"], {c: row[c] for c in ("x", "y", "id")}
                    out.append({"series": row["series"], "stretch": row["stretch"] + 1, **point})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run
