from .dashboards import kept, open_dashboard, run_dashboard, stacked_dashboard
from .pages import metric_by_date, series_by_position, two_metrics
from .payload import payload, payload_json, payload_text
from .reports import DASHBOARDS, find, run
from .store import ResultStore, files_state

__all__ = [
    "DASHBOARDS",
    "ResultStore",
    "files_state",
    "find",
    "kept",
    "metric_by_date",
    "open_dashboard",
    "payload",
    "payload_json",
    "payload_text",
    "run",
    "run_dashboard",
    "series_by_position",
    "stacked_dashboard",
    "two_metrics",
]
