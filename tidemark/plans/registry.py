"""All queries of the engine with their DuckDB twins; the modules below fill them in when imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TICKS = """t AS (SELECT event_type AS symbol, ts, 100 + value AS price, CAST(1 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS DOUBLE) AS quantity,
  user_id % 2 = 0 AS is_buyer_maker, event_id AS trade_id, user_id FROM events)"""


def candles_sql(interval: str = "1 hour", name: str = "c") -> str:
    return f"""{name} AS (SELECT symbol, time_bucket(INTERVAL '{interval}', ts, TIMESTAMP '1970-01-01') AS ts, first(price ORDER BY ts, trade_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, trade_id) AS close,
  sum(quantity) AS volume, sum(price * quantity) AS quote_volume, count(*) AS trades, sum(CASE WHEN is_buyer_maker THEN 0.0 ELSE quantity END) AS taker_buy_volume,
  sum(CASE WHEN is_buyer_maker THEN 0.0 ELSE price * quantity END) AS taker_buy_quote,
  time_bucket(INTERVAL '{interval}', ts, TIMESTAMP '1970-01-01') + INTERVAL '{interval}' - INTERVAL '1 millisecond' AS close_time FROM t GROUP BY 1, 2, 12)"""


def with_candles(body: str, interval: str = "1 hour", more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{TICKS}, {candles_sql(interval)}{', ' + more if more else ''} {body}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, and its twin where SQL can express it."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; -0.0 becomes 0.0."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits) + F.lit(0.0)


from tidemark.plans import q_aggregates, q_folds, q_joins, q_live, q_manage, q_ml, q_pipelines, q_scalars, q_sinks, q_sources, q_streaming, q_windows  # noqa: E402, F401
