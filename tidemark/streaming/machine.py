"""Bars of a live tape as a state machine: it takes ticks and commands, and closes bars by time, by command, or all at once.

A micro-batch is sorted by range, and neighbouring ticks of one bar become one line where they lie, on all tasks. Only these lines meet by
symbol; the machine takes them one after the other and holds a symbol's open bars.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAR = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, trades bigint"
#: A tick has kind `tick`; a command `close` closes bars that open at `ts` or before, `flush` closes all. Rows of a batch go by `seq`.
EVENT = "symbol string, ts timestamp, price double, quantity double, kind string, seq bigint"
#: Events may have the trade's id, by which rows of one seq or time go.
EVENT_ID = EVENT + ", id bigint"

#: What goes into the machine and comes out, by kind: ticks of bar b, the latest at t; commands at t; `bar`, a bar that is out; and the state:
#: `open`, a bar that is not, and `closed`, the last bar that is. Lines of a symbol go by i, which is -1 for the state.
_FIELDS = {"symbol": pa.string(), "kind": pa.string()} | dict.fromkeys(("b", "t"), pa.int64()) | dict.fromkeys(("open", "high", "low", "close", "volume"), pa.float64()) | dict.fromkeys(("trades", "first_t", "first_id", "last_t", "last_id", "i"), pa.int64())
_ARROW = pa.schema(list(_FIELDS.items()))
_LINE = ", ".join(f"{k} {'string' if pa.types.is_string(v) else 'bigint' if pa.types.is_int64(v) else 'double'}" for k, v in _FIELDS.items())


def tick_events(ticks: DataFrame) -> DataFrame:
    number = F.col("trade_id") if "trade_id" in ticks.columns else F.lit(None)
    return ticks.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "price", "quantity", F.lit("tick").alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"), number.cast("bigint").alias("id"))


def commands(symbols: DataFrame, kind: str, ts: Column, seq: Column) -> DataFrame:
    """One command for each symbol, at a place of the order."""
    return symbols.select("symbol", ts.cast("timestamp").alias("ts"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("double").alias("quantity"), F.lit(kind).alias("kind"), seq.cast("bigint").alias("seq"), F.lit(None).cast("bigint").alias("id"))


def _lines(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted events to lines: neighbouring ticks of one symbol and bar are one line, a command is one. A bar's ticks close other bars alone, so
    the machine takes or drops neighbours together."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            col = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("t", "id", "i", "price", "quantity", "is_tick")}
            t, price, tick = col["t"], col["price"], col["is_tick"].astype(bool)
            symbol, b = batch.column("symbol").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False), t // width * width
            at = np.flatnonzero(np.r_[True, (symbol[1:] != symbol[:-1]) | (b[1:] != b[:-1]) | ~tick[1:] | ~tick[:-1]])
            ends = np.r_[at[1:], n]
            order = np.lexsort((np.arange(n), col["id"], t, np.repeat(np.arange(len(at)), ends - at)))  # by time and id within a line
            first, last = order[at], order[ends - 1]
            known = ~np.isnan(col["quantity"])
            volume = np.where(np.add.reduceat(known.astype(np.int64), at) > 0, np.add.reduceat(np.where(known, col["quantity"], 0.0), at), np.nan)
            made = {
                "symbol": batch.column("symbol").take(pa.array(at)), "kind": batch.column("kind").take(pa.array(at)), "b": b[at], "t": np.maximum.reduceat(t, at), "open": price[first], "high": np.fmax.reduceat(price, at), "low": np.fmin.reduceat(price, at), "close": price[last],
                "volume": volume, "trades": ends - at, "first_t": t[first], "first_id": col["id"][first], "last_t": t[last], "last_id": col["id"][last], "i": col["i"][at],
            }
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, type=_FIELDS[k], from_pandas=True) for k, v in made.items()], schema=_ARROW)

    return lines


def _of(f: Callable, *values):
    """f of the values that are there."""
    there = [v for v in values if v is not None]
    return f(there) if there else None


def _merged(a: dict, b: dict) -> dict:
    """Two lines of one bar, the second of which came later."""
    first = b if (b["first_t"], b["first_id"]) < (a["first_t"], a["first_id"]) else a
    last = b if (b["last_t"], b["last_id"]) >= (a["last_t"], a["last_id"]) else a
    return a | {"high": _of(max, a["high"], b["high"]), "low": _of(min, a["low"], b["low"]), "volume": _of(sum, a["volume"], b["volume"]), "trades": a["trades"] + b["trades"]} | {k: first[k] for k in ("open", "first_t", "first_id")} | {k: last[k] for k in ("close", "last_t", "last_id")}


class _Symbol:
    """The machine's state for one symbol; `out` takes the bars that close."""

    def __init__(self, name: str | None, out: list[dict]):
        self.name, self.out, self.bars, self.closed = name, out, {}, None

    def close(self, limit: int | None) -> None:
        for b in sorted(x for x in self.bars if limit is None or x <= limit):
            self.out.append(self.bars.pop(b) | {"kind": "bar"})
            self.closed = b if self.closed is None else max(self.closed, b)

    def take(self, line: dict, width: int, grace: int | None) -> None:
        kind, b = line["kind"], line["b"]
        if kind == "closed":
            self.closed = b
        elif kind == "open":
            self.bars[b] = line
        elif kind == "flush":
            self.close(None)
        elif kind == "close":
            self.close(line["t"])
        elif self.closed is None or b > self.closed:  # else its bar is out
            self.bars[b] = _merged(self.bars[b], line) if b in self.bars else line
            if grace is not None:
                self.close(line["t"] - width - grace * 1_000_000)

    def end(self) -> None:
        self.out += [v | {"kind": "open", "i": -1} for v in self.bars.values()]
        if self.closed is not None:
            self.out.append(dict.fromkeys(_FIELDS) | {"symbol": self.name, "kind": "closed", "b": self.closed, "i": -1})


def _machine(width: int, grace: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        now = None
        for batch in batches:
            for line in batch.to_pylist():
                if now is None or now.name != line["symbol"]:
                    if now:
                        now.end()
                    now = _Symbol(line["symbol"], out)
                now.take(line, width, grace)
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
            out.clear()
        if now:
            now.end()
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return run


@dataclass(frozen=True)
class LiveBars:
    """Bars of a stream of events; `run` takes it on."""

    events: DataFrame
    seconds: int
    grace: int | None

    def step(self, events: DataFrame, state: DataFrame | None) -> DataFrame:
        """The bars that a micro-batch closes, and the state after it."""
        width = self.seconds * 1_000_000
        number = F.coalesce("id", F.lit(0)) if "id" in events.columns else F.lit(0).cast("bigint")
        kind = F.coalesce("kind", F.lit("tick"))
        is_tick = ~kind.isin("close", "flush")
        rows = events.where(~is_tick | F.col("ts").isNotNull()).select("symbol", F.when(is_tick, "tick").otherwise(kind).alias("kind"), is_tick.alias("is_tick"), F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("t"), "price", "quantity", "seq", number.alias("id"))
        by = ["symbol", "seq", "id"]
        placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("i", F.monotonically_increasing_id())
        lines = placed.mapInArrow(_lines(width), _LINE)
        met = lines if state is None else state.unionByName(lines)
        return met.repartition("symbol").sortWithinPartitions("symbol", "i").mapInArrow(_machine(width, self.grace), _LINE)


def live_bars(events: DataFrame, seconds: int, grace: int | None = 0) -> LiveBars:
    """Bars of a stream of EVENT rows. A bar closes `grace` seconds after its end has passed on the tape (None: by command alone); a tick for a
    bar that is out is dropped. The state is the open bars of a symbol and the last one that is out."""
    if grace is not None and grace < 0:
        raise ValueError("a bar can't close before its end")
    return LiveBars(events, seconds, grace)


def event_stream(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT_ID)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def run(stream: LiveBars, out: str, checkpoint: str) -> None:
    """Takes the stream as far as its source goes now; a later run with the same checkpoint goes on from there, with the state it left.

    A micro-batch writes its bars and its state by its number, so one that is tried again replaces what it wrote; the last two states stay.
    """
    at = lambda i: f"{checkpoint}/machine/_step={i}"

    def batch(events: DataFrame, i: int) -> None:
        spark = events.sparkSession
        left = spark.read.schema(_LINE).parquet(at(i - 1)).where("kind in ('open', 'closed')") if i else None
        stream.step(events, left).write.mode("overwrite").parquet(at(i))
        bars = spark.read.schema(_LINE).parquet(at(i)).where("kind = 'bar'")
        bars.select("symbol", F.timestamp_micros("b").alias("ts"), "open", "high", "low", "close", "volume", "trades").write.mode("overwrite").parquet(f"{out}/_batch={i}")
        if i > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(at(i - 2))
            old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)

    stream.events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
