"""Named-query registry: Spark builder + optional DuckDB oracle text per name."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``sql`` is the DuckDB text of the same result (column names aliased
    identically); omit it for results SQL cannot state (hash-based
    sampling, fitted models) — those get a rows-only check.
    """
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


def with_sales(body: str, geo: bool = False) -> str:
    """Prefix an oracle query with the ``sales`` CTE of the binding."""
    from choicelens.plans.bindings import SALES_GEO_SQL, SALES_LINES_SQL
    cte = SALES_GEO_SQL if geo else SALES_LINES_SQL
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + cte.strip() + ",\n" + body[5:]
    return "WITH " + cte.strip() + "\n" + body
