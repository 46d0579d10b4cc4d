"""Transforms of point series.

A series frame is long: ``series``, ``x``, ``y`` and a numeric ``id`` that makes
points of a series distinct.  Points of a series are ordered by ``x`` and then
``id``.  Any series may be far larger than one task can hold.
"""

from .decimate import decimate_visible, lttb_decimate, min_max_decimate
from .extents import adjust_extents, extents
from .labels import label_index, label_positions
from .points import (
    arrays_to_points,
    map_to_points,
    objects_to_points,
    pairs_to_points,
    positive_only,
    range_values,
)
from .segments import gap_segments, is_sorted, range_slice
from .stacking import share_of_total, stack_series
from .timeline import (
    calendar_fill,
    calendar_spine,
    distinct_times,
    smallest_step,
    time_bucket,
    time_positions,
    time_rank,
)

__all__ = [
    "adjust_extents",
    "arrays_to_points",
    "calendar_fill",
    "calendar_spine",
    "decimate_visible",
    "distinct_times",
    "extents",
    "gap_segments",
    "is_sorted",
    "label_index",
    "label_positions",
    "lttb_decimate",
    "map_to_points",
    "min_max_decimate",
    "objects_to_points",
    "pairs_to_points",
    "positive_only",
    "range_slice",
    "range_values",
    "share_of_total",
    "smallest_step",
    "stack_series",
    "time_bucket",
    "time_positions",
    "time_rank",
]
