"""What runs inside tasks for min-max decimation: numpy over Arrow batches."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from .triangle import _changes, _codes

# Sent along with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _values(column: pa.Array) -> np.ndarray:
    """Doubles, NaN for NULL."""
    return column.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)


def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each (series, column) of a batch the first, lowest, highest and last row.

    Rows come with ``_col`` (NULL for rows that stay whatever they are), which all
    pass.  Of equal values the earliest row is lowest or highest; a row whose value
    is NULL or NaN can only be first or last.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        single = batch["_col"].is_null().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(~single)
        if len(at):
            part = batch.take(pa.array(at))
            series, col = _codes(part["series"]), part["_col"].to_numpy(zero_copy_only=False)
            x, ids = part["x"].to_numpy(zero_copy_only=False), part["id"].to_numpy(zero_copy_only=False)
            y = _values(part["y"])
            order = np.lexsort((ids, x, col, series))
            head = np.flatnonzero(_changes(series[order], col[order]))
            keep = np.zeros(len(at), dtype=bool)
            keep[order[head]] = True
            keep[order[np.append(head[1:], len(order)) - 1]] = True
            group = np.empty(len(at), dtype=np.int64)
            group[order] = np.cumsum(_changes(series[order], col[order]))
            known = np.flatnonzero(~np.isnan(y))
            for size in (y, -y):
                by = known[np.lexsort((ids[known], x[known], size[known], group[known]))]
                if len(by):
                    keep[by[_changes(group[by])]] = True
            single[at[keep]] = True
        yield batch.filter(pa.array(single))
