from .files import read_csv_inferred, read_label_value_csv, read_tables, rows_frame
from .footers import by_footers, column_ends
from .jdbc import KeySpans, day_predicates, jdbc_table, read_jdbc_tables

__all__ = [
    "KeySpans",
    "by_footers",
    "column_ends",
    "day_predicates",
    "jdbc_table",
    "read_csv_inferred",
    "read_jdbc_tables",
    "read_label_value_csv",
    "read_tables",
    "rows_frame",
]
