"""Live bars: the state machine driven by ticks and commands, recovery after a stop, subscriptions, marks and joins of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import candles as K
from tidemark.plans.registry import TICKS, query, rounded, with_candles
from tidemark.session import scratch, stored
from tidemark.sources.clients import retried
from tidemark.sources.tables import candles, predictions, trades
from tidemark.streaming import candles as S
from tidemark.streaming import machine as L

_BAR = "symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume, trades"
_LAST = 1 << 62


def bars_of(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(L.BAR).parquet(path).drop("_batch")
    return rounded(rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


def driven(spark: SparkSession, d: str, kind: str, at: str | None = None, grace: int | None = 0) -> DataFrame:
    """The bars that come out when all ticks and then one command run through the machine."""
    folder, out, state = scratch(spark, "events"), scratch(spark, "bars"), scratch(spark, "state")
    ticks = L.tick_events(trades(spark, d))
    stop = L.commands(ticks.select("symbol").distinct(), kind, F.lit(at).cast("timestamp"), F.lit(_LAST))
    ticks.unionByName(stop).write.parquet(folder)
    L.run(L.live_bars(L.event_stream(spark, folder), 3600, grace), out, state)
    return bars_of(spark, out)


query("st_flush", with_candles(f"SELECT {_BAR} FROM c"))(lambda spark, d: driven(spark, d, "flush"))
query("st_force_close", with_candles(f"SELECT {_BAR} FROM c WHERE ts <= TIMESTAMP '2024-01-10 06:00:00'"))(lambda spark, d: driven(spark, d, "close", "2024-01-10 06:00:00", None))


@query("st_recover", with_candles(f"SELECT {_BAR} FROM c"))
def st_recover(spark: SparkSession, d: str) -> DataFrame:
    """The stream stops in the middle of a bar and misses ticks; a later run takes them from the tape, behind the last one it has seen, and
    goes on with the state of its checkpoint. Ticks that come twice fall behind the last one and are not fetched."""
    folder, out, state = scratch(spark, "events"), scratch(spark, "bars"), scratch(spark, "state")
    tape = L.tick_events(trades(spark, d))
    tape.where("ts < timestamp'2024-01-12 10:17:00'").write.parquet(folder)
    stream = L.live_bars(L.event_stream(spark, folder), 3600, 0)
    L.run(stream, out, state)
    seen = spark.read.schema(L.EVENT).parquet(folder).groupBy("symbol").agg(F.max("seq").alias("last"))
    missed = tape.join(F.broadcast(seen), "symbol", "left").where("last is null or seq > last").drop("last")  # one row for each symbol
    missed.unionByName(L.commands(tape.select("symbol").distinct(), "flush", F.lit(None), F.lit(_LAST))).write.mode("append").parquet(folder)
    L.run(stream, out, state)
    return bars_of(spark, out)


@query("st_prediction_marks", with_candles("SELECT symbol, ts, round(1 / (1 + exp(-(close - open) / 10)), 8) AS mark FROM c"))
def st_prediction_marks(spark: SparkSession, d: str) -> DataFrame:
    """Marks arrive in two waves, first even ones, then predictions; the newest of each bar stays."""
    folder, out = scratch(spark, "marks"), scratch(spark, "marked")
    p = predictions(spark, d)
    for mark in (F.lit(0.5), F.col("prob_up")):
        p.select("symbol", F.col("ts").cast("timestamp").alias("ts"), mark.alias("mark")).coalesce(1).write.mode("append").parquet(folder)
    S.upsert_stream(spark.readStream.schema("symbol string, ts timestamp, mark double").option("maxFilesPerTrigger", 1).parquet(folder), out)
    latest = spark.read.parquet(out).groupBy("symbol", "ts").agg(F.max_by("mark", "_v").alias("mark"))
    return rounded(latest.withColumn("ts", F.col("ts").cast("timestamp_ntz")), 8)


@query("st_step_retry", with_candles("SELECT symbol, count(*) AS bars, 2 AS attempts FROM c GROUP BY 1"))
def st_step_retry(spark: SparkSession, d: str) -> DataFrame:
    """A micro-batch's step whose first attempt fails after it has written something: the second writes the batch anew, and no row is there twice."""
    folder, out, tried = scratch(spark, "bars"), scratch(spark, "steps"), []
    candles(spark, d).select("symbol", "close").write.parquet(folder)

    def step(df: DataFrame, i: int) -> None:
        tried.append(i)
        df.write.mode("overwrite").parquet(f"{out}/_batch={i}")
        if tried.count(i) == 1:
            raise ConnectionError("the sink went away")

    def batch(df: DataFrame, i: int) -> None:
        retried(step, df, i, wait=0.0)

    spark.readStream.schema("symbol string, close double").parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    most = max((tried.count(i) for i in tried), default=0)
    return spark.read.parquet(out).groupBy("symbol").agg(F.count("*").alias("bars")).withColumn("attempts", F.lit(most))


def refcounts(changes: DataFrame, delta: str = "delta", keys: tuple[str, ...] = ("symbol",), order: str = "ts", ties: tuple[str, ...] = ()) -> DataFrame:
    """changes with refs, the number of subscribers that never falls below 0, and the action that starts or stops a stream.

    The number is the running sum less its lowest point below 0 so far, so it needs no fold. Changes of one time count as one: each of
    them has the number after all, and the first by `ties` the action.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    so_far = w.rangeBetween(Window.unboundedPreceding, 0)
    df = changes.withColumn("_s", F.sum(delta).over(so_far))
    df = df.withColumn("refs", F.col("_s") - F.least(F.lit(0), F.min("_s").over(so_far)))
    before = F.coalesce(F.lag("refs").over(w.orderBy(order, *ties)), F.lit(0))
    return df.withColumn("action", F.when((before == 0) & (F.col("refs") > 0), "start").when((before > 0) & (F.col("refs") == 0), "stop")).drop("_s")


query("st_refcount_streams", f"""WITH {TICKS}, s AS (SELECT *, sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END) OVER (PARTITION BY symbol ORDER BY ts) AS s FROM t), r AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY symbol ORDER BY ts)) AS refs FROM s)
SELECT trade_id, CAST(refs AS BIGINT) AS refs, CASE WHEN p = 0 AND refs > 0 THEN 'start' WHEN p > 0 AND refs = 0 THEN 'stop' END AS action FROM (SELECT *, coalesce(lag(refs) OVER (PARTITION BY symbol ORDER BY ts), 0) AS p FROM r)""")(
    lambda spark, d: refcounts(trades(spark, d).withColumn("delta", F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1)), ties=("trade_id",)).select("trade_id", "refs", "action")
)


@query("st_stream_join", f"WITH {TICKS} SELECT a.trade_id AS view_id, b.trade_id AS purchase_id, a.user_id FROM t a JOIN t b ON a.symbol = 'view' AND b.symbol = 'purchase' AND a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 12 hours")
def st_stream_join(spark: SparkSession, d: str) -> DataFrame:
    """Two streams joined on a key and a range of time; watermarks bound what either side keeps."""
    ticks = S.tick_stream(spark, d)
    views = ticks.where("symbol = 'view'").select(F.col("trade_id").alias("view_id"), "user_id", F.col("ts").alias("seen")).withWatermark("seen", "1 day")
    bought = ticks.where("symbol = 'purchase'").select(F.col("trade_id").alias("purchase_id"), F.col("user_id").alias("buyer"), F.col("ts").alias("at")).withWatermark("at", "1 day")
    return S.drain(views.join(bought, F.expr("user_id = buyer and at between seen and seen + interval 12 hours")).select("view_id", "purchase_id", "user_id"), "joined")


query("st_watermark", with_candles("SELECT symbol, ts, round(close, 6) AS close, trades FROM c WHERE epoch_us(ts) + 900000000 <= (SELECT epoch_ms(max(ts)) * 1000 - 600000000 FROM t)", "15 minutes"))(
    lambda spark, d: rounded(S.drain(S.tumbling_candles(S.tick_stream(spark, d), 900, "10 minutes"), "late").select("symbol", "ts", "close", "trades"))
)
query("st_dedup_watermark", f"WITH {TICKS} SELECT symbol, count(*) AS ticks FROM t GROUP BY 1")(
    lambda spark, d: (lambda s: S.drain(s.unionByName(s).withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["trade_id"]), "unique").groupBy("symbol").agg(F.count("*").alias("ticks")))(S.tick_stream(spark, d))
)
query("store_retention", "SELECT * FROM (VALUES (2, 102.5::DOUBLE, 'written'), (3, 103.5, 'written'), (4, 104.5, 'written'), (2, 102.5, 'rewritten'), (3, 103.5, 'rewritten'), (4, 104.5, 'rewritten')) v(minute, close, step)")(lambda spark, d: store_retention(spark))


def store_retention(spark: SparkSession) -> DataFrame:
    """Five bars in a store that keeps three; the newest two written again; then nothing: what the store holds after each step."""
    bars = spark.range(5).select(F.lit("BTCUSDT").alias("symbol"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"), *[(F.lit(x) + F.col("id")).alias(c) for c, x in (("open", 100.0), ("high", 101.0), ("low", 99.0), ("close", 100.5), ("volume", 10.0))])
    once = K.upsert_retain(bars.limit(0), bars, 3)
    twice = K.upsert_retain(once, bars.where("minute(ts) >= 3"), 3)
    cleared = twice.limit(0)
    steps = [(once, "written"), (twice, "rewritten"), (cleared, "cleared")]
    parts = [df.select(F.minute("ts").alias("minute"), "close", F.lit(name).alias("step")) for df, name in steps]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def sse(event: str, payload: Column) -> Column:
    """A server-sent event: its name and one line of JSON."""
    return F.concat(F.lit(f"event: {event}\ndata: "), F.to_json(payload), F.lit("\n\n"))


@query("sink_sse_ws", with_candles("SELECT symbol, 'event: candle' || chr(10) || 'data: {\"symbol\":\"' || symbol || '\",\"ts_ms_utc\":' || epoch_ms(ts) || ',\"trades\":' || trades || '}' || chr(10) || chr(10) AS event FROM c"))
def sink_sse_ws(spark: SparkSession, d: str) -> DataFrame:
    """A stream of bars written as server-sent events, each batch by the tasks that hold it; a server sends on what it finds."""
    folder = scratch(spark, "bars")
    candles(spark, d).select("symbol", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms_utc"), "trades").write.parquet(folder)
    bars = spark.readStream.schema("symbol string, ts_ms_utc bigint, trades bigint").parquet(folder)
    events = bars.select("symbol", sse("candle", F.struct("symbol", "ts_ms_utc", "trades")).alias("event"))
    return S.drain(events, "events")


@query("pipe_collect", with_candles("SELECT symbol, ts, round(close, 6) AS close, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'history' ELSE 'live' END AS origin FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 500"))
def pipe_collect(spark: SparkSession, d: str) -> DataFrame:
    """Stored history, and the bars of a live stream over it: a bar that both have is the live one; the newest 500 of a symbol stay."""
    c = candles(spark, d).select("symbol", "ts", "open", "high", "low", "close", "volume")
    history = stored(c.where("ts < timestamp_ntz'2024-01-21'"), "history").withColumn("origin", F.lit("history"))
    folder = scratch(spark, "live")
    c.where("ts >= timestamp_ntz'2024-01-20'").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(folder)
    live = S.drain(spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder), "live").withColumn("origin", F.lit("live"))
    return rounded(K.newest(K.keep_last([history, live]), 500).select("symbol", "ts", "close", "origin"))
