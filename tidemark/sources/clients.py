"""Sources that are fetched page by page from a client: retries, paging forwards and backwards, and Spark data sources over them.

A client is a function (start_ms, end_ms, limit) that returns rows (klines, trades) up to end_ms in order of time: the first `limit` from
start_ms on, or the last `limit` where start_ms is None. The first value of a row is its time in ms. The offline series is such a client;
one for a network takes its place.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.generators import CLOSE, LEVEL, LOWER, OPEN, UPPER, VOLUME, VOLUME_STEP, VOLUME_WAVE, WAVES

Client = Callable[[int | None, int, int], Sequence[Sequence]]
#: Rows of a page, the most pages of a backward run, attempts and seconds between them.
PAGE, MAX_PAGES, ATTEMPTS, WAIT = 1000, 100, 3, 0.2

KLINE_FIELDS = ("open_time bigint, open string, high string, low string, close string, volume string, close_time bigint", [pa.int64(), *[pa.string()] * 5, pa.int64()])
TRADE_FIELDS = ("trade_time bigint, trade_id bigint, price string, quantity string, is_buyer_maker boolean", [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()])


def retried(call: Callable, *args: object, attempts: int = ATTEMPTS, wait: float = WAIT) -> tuple[object, int]:
    """What the call returns, and how many attempts it took; the last attempt's error is raised."""
    for n in range(1, attempts + 1):
        try:
            return call(*args), n
        except Exception:
            if n == attempts:
                raise
            time.sleep(wait * n)
    raise ValueError("attempts must be positive")


def offline_klines(step_ms: int = 60_000) -> Client:
    """The offline series as a client."""

    def fetch(start_ms: int | None, end_ms: int, limit: int) -> list[tuple]:
        last = end_ms // step_ms
        first = max(0, last - limit + 1) if start_ms is None else -(-start_ms // step_ms)
        i = np.arange(first, min(last, first + limit - 1) + 1)
        base = LEVEL + np.sin(i / WAVES[0][1]) * WAVES[0][0] + np.cos(i / WAVES[1][1]) * WAVES[1][0]
        o, c = base + np.sin(i / OPEN[1]) * OPEN[0], base + np.cos((i + 0.5) / CLOSE[1]) * CLOSE[0]
        high = np.maximum(o, c) + np.abs(np.sin(i / UPPER[1])) * UPPER[0] + UPPER[2]
        low = np.minimum(o, c) - np.abs(np.cos(i / LOWER[1])) * LOWER[0] - LOWER[2]
        volume = VOLUME + np.abs(np.sin(i / VOLUME_WAVE[1])) * VOLUME_WAVE[0] + i % 10 * VOLUME_STEP
        times = (i * step_ms).tolist()
        texts = [[f"{x:.2f}" for x in v.tolist()] for v in (o, high, low, c)]
        return list(zip(times, *texts, [f"{x:.3f}" for x in volume.tolist()], [t + step_ms - 1 for t in times]))

    return fetch


def offline_trades(step_ms: int = 250) -> Client:
    """A tape of one trade each step_ms milliseconds."""

    def fetch(start_ms: int | None, end_ms: int, limit: int) -> list[tuple]:
        last = end_ms // step_ms
        first = max(0, last - limit + 1) if start_ms is None else -(-start_ms // step_ms)
        i = range(first, min(last, first + limit - 1) + 1)
        return [(k * step_ms, k, f"{LEVEL + k % 977 / 4:.2f}", f"{1 + k % 13 / 10:.1f}", k % 2 == 0) for k in i]

    return fetch


def pages_forward(fetch: Client, start_ms: int, end_ms: int, limit: int = PAGE) -> Iterator[Sequence[Sequence]]:
    """Pages from start_ms on, each from behind the last row of the one before; a short page is the last. end_ms is included."""
    at = start_ms
    while at <= end_ms:
        page = retried(fetch, at, end_ms, limit)[0]
        if not page:
            return
        yield page
        last = int(page[-1][0])
        if len(page) < limit or last < at:
            return
        at = last + 1


def pages_backward(fetch: Client, end_ms: int, minimum: int = 0, start_ms: int | None = None, limit: int = PAGE, max_pages: int = MAX_PAGES, now_ms: int | None = None) -> Iterator[Sequence[Sequence]]:
    """Pages back from end_ms (clamped to now, if given) until start_ms is reached, or so many rows at least, or there are no more. Where
    max_pages do not get there, that is an error: what lies beyond them is not left out in silence."""
    at, got = end_ms if now_ms is None else min(end_ms, now_ms), 0
    for _ in range(max_pages):
        page = retried(fetch, None, at, limit)[0]
        if not page:
            return
        yield page
        got += len(page)
        first = int(page[0][0])
        if first <= (start_ms or 0) or start_ms is None and 0 < minimum <= got:
            return
        at = first - 1
    raise RuntimeError(f"{max_pages} pages end at {at + 1}, before what was asked for: from {start_ms}, at least {minimum} rows")


def paged_source(name: str, fetch: Client, fields: tuple[str, list[pa.DataType]] = KLINE_FIELDS) -> type[DataSource]:
    """A data source `spark.read.format(name)` over a client.

    Options: start_ms and end_ms (both included); chunk_ms, the width of a partition; mode forward (the default), or backward: one
    partition that pages back from end_ms to start_ms or until `minimum` rows are there. Rows that two pages share come once.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.backward = options.get("mode", "forward") == "backward"
            self.start, self.end = (int(options[k]) if k in options else None for k in ("start_ms", "end_ms"))
            self.chunk, self.minimum, self.max_pages = int(options.get("chunk_ms", PAGE * 20 * 60_000)), int(options.get("minimum", 0)), int(options.get("max_pages", MAX_PAGES))

        def partitions(self) -> list[InputPartition]:
            if self.backward:
                return [InputPartition((self.start, self.end))]
            return [InputPartition((a, min(self.end, a + self.chunk - 1))) for a in range(self.start, self.end + 1, self.chunk)] or [InputPartition((0, -1))]

        def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
            a, b = partition.value
            pages = pages_backward(fetch, b, self.minimum, a, max_pages=self.max_pages) if self.backward else pages_forward(fetch, a, b)
            edge = None  # pages of one run are in order, so a row is new if it lies beyond the last page
            names = [f.split()[0] for f in fields[0].split(", ")]
            for page in pages:
                rows = [r for r in page if (a is None or r[0] >= a) and (edge is None or (r[0] < edge if self.backward else r[0] > edge))]
                if rows:
                    edge = min(r[0] for r in rows) if self.backward else max(r[0] for r in rows)
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(fields[1])], names=names)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return fields[0]

        def reader(self, schema: object) -> DataSourceReader:
            return Reader(self.options)

    return Source
