"""Named queries over the driver tables and their DuckDB oracle SQL.

Each query is ``f(spark, sf_dir) -> DataFrame`` and reads whole tables.
Doubles are rounded to 6 digits on both sides so value hashes agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivener.functions.numeric import round_half_away

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (top level) to ``digits``."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_half_away(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def query(name: str, oracle: str | None = None):
    """Register a query (and its oracle SQL when it has one)."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Naive driver timestamps are UTC wall times; epoch conversions
            # (window bounds in ms, alert steps, session gaps) assume UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run
    return deco


# Tables the oracle SQL reads (views in the checker's DuckDB).
ORACLE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")
_BIND_DIR = "/root/testdata/sf0.001"
_bind_con = None


def _double_columns(sql: str) -> list[str]:
    """DOUBLE output columns of ``sql``, found by binding it in DuckDB over
    the smallest tables (no execution)."""
    global _bind_con
    if _bind_con is None:
        import duckdb
        con = duckdb.connect()
        for t in ORACLE_TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{_BIND_DIR}/{t}.parquet')")
        _bind_con = con
    rel = _bind_con.sql(sql)
    return [c for c, t in zip(rel.columns, rel.types) if str(t) in ("DOUBLE", "FLOAT", "REAL")]


def rounded_sql(sql: str, digits: int = DIGITS) -> str:
    """The oracle SQL with every DOUBLE column rounded like ``round_doubles``,
    so both sides carry identical values whatever float handling the
    comparison uses. Falls back to the SQL as written if it cannot be bound."""
    try:
        cols = _double_columns(sql)
    except Exception:
        return sql
    if not cols:
        return sql
    rep = ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS _q"


def load_all() -> None:
    """Import the modules that register queries."""
    from scrivener.plans import (  # noqa: F401
        q_windows, q_events, q_tables, q_notify, q_marts, q_similarity, q_ingest, q_metrics,
        q_streaming)
