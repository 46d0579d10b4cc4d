"""The registered queries and the SQL they are checked against."""

from . import pages, reports, series

MODULES = [reports, pages, series]


def queries() -> dict:
    return {name: q for module in MODULES for name, q in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for module in MODULES for name, s in module.SQL.items()}
