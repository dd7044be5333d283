"""Named queries over the driver tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.sources.model import TRX_SQL

def mean_sql(value: str, digits: int, scale: int = 6) -> str:
    """Mean rounded half up in whole numbers (for values >= 0)."""
    units = f"({value})::DECIMAL(26,{scale})"
    n, step = f"count({value})", 10 ** (scale - digits)
    whole = f"(sum({units}) * {10**scale})::HUGEINT"
    return f"(((2 * {whole} + {n} * {step}) // nullif(2 * {n} * {step}, 0))::DOUBLE / {10**digits})"


Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, trx: bool = False, ctes: str = ""):
    """Register a query under its function name.

    ``trx`` puts the transaction model in front of the SQL, ``ctes`` more of the
    shared table expressions.
    """

    def register(fn: Query) -> Query:
        if fn.__name__ in QUERIES:
            raise ValueError(f"query {fn.__name__} exists")
        QUERIES[fn.__name__] = fn
        if sql is not None:
            parts = [p for p in ((TRX_SQL if trx else ""), ctes) if p]
            ORACLES[fn.__name__] = (f"WITH {', '.join(p.strip() for p in parts)}\n{sql}" if parts else sql).strip()
        return fn

    return register
