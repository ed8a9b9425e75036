"""Structured Streaming: candles from ticks, gap fill with state, and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.candles import trade_order
from tidemark.session import scratch
from tidemark.sources.tables import trades


def tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tick tape as a stream of files; watermarks need timestamps with a zone."""
    folder = scratch(spark, "ticks")
    trades(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


def tumbling_candles(ticks: DataFrame, seconds: int, delay: str = "0 seconds") -> DataFrame:
    """Bars in append mode: a bar comes out once the watermark passes its end; ticks behind it are dropped."""
    taker = lambda x: F.sum(F.when(~F.col("is_buyer_maker"), x).otherwise(0.0))
    at = trade_order(ticks)
    g = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("quantity").alias("volume"), F.count("*").alias("trades"), taker(F.col("quantity")).alias("taker_buy_volume"),
    )
    return g.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "trades", "taker_buy_volume")


def _fill(seconds: int):
    step = pd.Timedelta(seconds=seconds)

    def fill(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_ts, last_close = state.get if state.exists else (None, None)
        rows = []
        for r in pd.concat(list(parts)).sort_values("ts").itertuples(index=False):
            if last_ts is not None:
                t = pd.Timestamp(last_ts, unit="us") + step
                while t < r.ts:
                    rows.append((key[0], t, last_close, last_close, last_close, last_close, 0.0, True))
                    t += step
            rows.append((key[0], r.ts, r.open, r.high, r.low, r.close, r.volume, False))
            last_ts, last_close = int(r.ts.value // 1000), float(r.close)
        state.update((last_ts, last_close))
        yield pd.DataFrame(rows, columns=["symbol", "ts", "open", "high", "low", "close", "volume", "is_synthetic"])

    return fill


def fill_gaps_stream(bars: DataFrame, seconds: int) -> DataFrame:
    """Flat synthetic bars between a symbol's bars, as they arrive: the state is the last bar's time and close."""
    return bars.groupBy("symbol").applyInPandasWithState(
        _fill(seconds), "symbol string, ts timestamp, open double, high double, low double, close double, volume double, is_synthetic boolean", "ts long, close double", "append", GroupStateTimeout.NoTimeout
    )


def drain(stream: DataFrame, label: str, mode: str = "append", ts: str = "ts") -> DataFrame:
    """Runs a stream over what its source holds now and returns the rows that came out."""
    spark = stream.sparkSession
    out, state = scratch(spark, f"{label}-out"), scratch(spark, f"{label}-state")
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(out)
    return rows.withColumn(ts, F.col(ts).cast("timestamp_ntz")) if ts in rows.columns else rows


def upsert_stream(stream: DataFrame, folder: str, keys: tuple[str, ...] = ("symbol", "ts")) -> None:
    """Drains a stream into a table of versions: each micro-batch is appended with its number, once."""
    state = scratch(stream.sparkSession, "upsert-state")
    write = lambda df, i: df.withColumn("_v", F.lit(i)).write.mode("overwrite").parquet(f"{folder}/_batch={i}")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

