from .scalars import (
    full_name,
    hour_label,
    month_label,
    null_if_blank,
    percent,
    ratio,
    seconds_between,
    value_order,
)

__all__ = [
    "full_name",
    "hour_label",
    "month_label",
    "null_if_blank",
    "percent",
    "ratio",
    "seconds_between",
    "value_order",
]
