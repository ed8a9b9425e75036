"""Deterministic candles without a network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START = "2024-01-01"
#: Fixed values of the offline series: level; (height, period) of its waves and of the offsets of open, close, wicks and volume.
LEVEL, WAVES, OPEN, CLOSE, UPPER, LOWER = 26000, ((900, 180.0), (320, 55.0)), (120, 12.0), (110, 9.0), (60, 5.0, 25), (60, 7.0, 25)
VOLUME, VOLUME_WAVE, VOLUME_STEP = 500, (220, 15.0), 12


def offline_candles(spark: SparkSession, n: int, start: str = START, seconds: int = 60) -> DataFrame:
    """n bars of overlaid waves, rounded to 2 decimals, volumes to 3. The start is a parameter, so that results repeat."""
    i = F.col("id")
    base = LEVEL + F.sin(i / WAVES[0][1]) * WAVES[0][0] + F.cos(i / WAVES[1][1]) * WAVES[1][0]
    o, c = base + F.sin(i / OPEN[1]) * OPEN[0], base + F.cos((i + 0.5) / CLOSE[1]) * CLOSE[0]
    ts = F.timestamp_seconds(F.unix_seconds(F.lit(start).cast("timestamp")) + i * seconds).cast("timestamp_ntz")
    return spark.range(n).select(
        ts.alias("ts"), F.round(o, 2).alias("open"), F.round(F.greatest(o, c) + F.abs(F.sin(i / UPPER[1])) * UPPER[0] + UPPER[2], 2).alias("high"),
        F.round(F.least(o, c) - (F.abs(F.cos(i / LOWER[1])) * LOWER[0] + LOWER[2]), 2).alias("low"), F.round(c, 2).alias("close"),
        F.round(VOLUME + F.abs(F.sin(i / VOLUME_WAVE[1])) * VOLUME_WAVE[0] + (i % 10) * VOLUME_STEP, 3).alias("volume"),
    )


def offline_slice(bars: DataFrame, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    """Bars within [start, end]; with a start the oldest `limit`, else the newest, in order of time."""
    if start:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        bars = bars.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    if limit is None:
        return bars.orderBy("ts")
    return bars.orderBy("ts").limit(limit) if start else bars.orderBy(F.desc("ts")).limit(limit).orderBy("ts")


def random_walk(spark: SparkSession, n: int, seed: int, symbols: int = 5) -> DataFrame:
    """Bars of seeded random walks, one for each symbol."""
    w = Window.partitionBy("symbol").orderBy("i")
    rows = spark.range(n * symbols).select((F.col("id") % symbols).cast("string").alias("symbol"), F.floor(F.col("id") / symbols).alias("i"), (F.randn(seed) * 0.002).alias("step"))
    close = 100 * F.exp(F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("close", close).withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(100.0)))
    return rows.select("symbol", F.timestamp_seconds(F.col("i") * 60).alias("ts"), "open", (F.greatest("open", "close") * 1.001).alias("high"), (F.least("open", "close") * 0.999).alias("low"), "close")
