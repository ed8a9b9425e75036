"""Sum-of-squares online packing of documents into token windows.

A task packs the documents of its input partition as they stream by. Whole windows of a long document become sequences of their own; its
last part goes to the fill level that leaves the smallest sum of squared counts of partly filled windows. The counts by level are the
level array; the windows behind it hold their pieces until they are full. When a task ends, or when MAX_OPEN windows are open, what the
open windows hold is joined and cut into full windows; the remainder at the end is cut at powers of two, which need no padding.
A sequence's number is made of its partition's number and a count, so that no task waits for another and nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tidemark.llm.bpe import byte_letters, plain_words
from tidemark.llm.common import texts

#: At most 2048 windows of 16 KB are open: in a partition of 10,000 documents there were 318 at most, and the one join at its end moved 13 % of the tokens.
WINDOW, END_ID, MAX_OPEN = 4096, 2, 2048
#: Pre-tokens that a worker keeps before they age, and the longest that are kept.
CACHE_WORDS, CACHE_LETTERS = 400_000, 32
SEQUENCE_BITS = 36


class LibraryIds:
    """ids by the tokenizers library as little-endian unsigned 32-bit bytes. Pre-tokens of plain texts are encoded once, by the library's
    model, and kept; when CACHE_WORDS are, they become the old ones, of which those that occur again are taken over."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.letter = [byte_letters()[b] for b in range(256)]
        self.coded = [i.to_bytes(4, "little") for i in range(max(self.library.get_vocab(with_added_tokens=True).values()) + 1)]
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, words: Iterable[str]) -> None:
        """Takes in the ids of unknown pre-tokens."""
        known, old, tokenize, coded, letter = self.known, self.old, self.model.tokenize, self.coded, self.letter
        for w in words:
            x = old.get(w)
            if x is None:
                x = b"".join([coded[t.id] for t in tokenize(w if w.isascii() and w.isalpha() else "".join([letter[b] for b in w.encode()]))])
            known[w] = x

    def __call__(self, text: str | None) -> bytes:
        words = plain_words(text or "")
        if words is None:
            return np.asarray(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()
        unknown = set(words).difference(self.known)
        if not unknown:
            return b"".join(map(self.known.__getitem__, words))
        self.learn(unknown)
        out = b"".join(map(self.known.__getitem__, words))
        for w in [w for w in unknown if len(w) > CACHE_LETTERS]:
            del self.known[w]
        if len(self.known) > CACHE_WORDS:
            self.old, self.known = self.known, {}
        return out


@lru_cache(maxsize=2)
def library_ids(path: str) -> LibraryIds:
    return LibraryIds(path)


class SumOfSquares:
    """Packs pieces of at most `window` tokens; `emit` gets (sequence number, pieces) of every sequence that is complete.

    A piece is (tag, start, ids as bytes). Sequences are numbered from 0.
    """

    def __init__(self, window: int, emit: Callable[[int, list], None], max_open: int = MAX_OPEN) -> None:
        self.window, self.emit, self.max_open = window, emit, max_open
        self.count = np.zeros(window + 1, np.int64)  # the level array: partly filled windows by fill
        self.held: list[list[list]] = [[] for _ in range(window + 1)]
        self.open = self.next = 0

    def close(self, pieces: list) -> None:
        self.emit(self.next, pieces)
        self.next += 1

    def add(self, tag: object, ids: bytes) -> None:
        n, w = len(ids) // 4, self.window
        full = n - n % w
        for a in range(0, full, w):
            self.close([(tag, a, ids[4 * a : 4 * (a + w)])])
        if n > full:
            self.place((tag, full, ids[4 * full :]), n - full)

    def place(self, piece: tuple, size: int) -> None:
        """The fill level at which the piece raises the sum of squares least; of equals the fullest. Level 0 is a new window."""
        w, c = self.window, self.count
        levels = c[: w - size + 1]
        rise = 2 * c[size : w + 1] + 1  # of the level that the window comes to
        rise[-1] = 0  # a full window counts no more
        rise[1:] += 1 - 2 * levels[1:]
        rise[1:][levels[1:] == 0] = np.iinfo(np.int64).max
        level = len(rise) - 1 - int(np.argmin(rise[::-1]))
        if level:
            pieces = self.held[level].pop()
            c[level] -= 1
            self.open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == w:
            self.close(pieces)
            return
        self.held[level + size].append(pieces)
        c[level + size] += 1
        self.open += 1
        if self.open >= self.max_open:
            self.join(final=False)

    def join(self, final: bool) -> None:
        """Cuts what the open windows hold into full windows, fullest first; at the end the rest at powers of two."""
        parts = [p for level in range(self.window, 0, -1) for pieces in self.held[level] for p in pieces]
        self.count[:] = 0
        self.held, self.open = [[] for _ in range(self.window + 1)], 0
        total = sum(len(p[2]) // 4 for p in parts)
        sizes = [self.window] * (total // self.window)
        rest = total % self.window
        if final:
            sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        at, used = 0, 0
        for size in sizes:
            pieces, free = [], size
            while free:
                tag, start, ids = parts[at]
                take = min(free, len(ids) // 4 - used)
                pieces.append((tag, start + used, ids[4 * used : 4 * (used + take)]))
                free, used = free - take, used + take
                if used == len(ids) // 4:
                    at, used = at + 1, 0
            self.close(pieces)
        left = [(tag, start + (used if i == 0 else 0), ids[4 * used :] if i == 0 else ids) for i, (tag, start, ids) in enumerate(parts[at:])]
        if left:
            self.held[rest].append(left)
            self.count[rest], self.open = 1, 1


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, max_open: int = MAX_OPEN, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids, if asked for).

    Every document, null and empty ones too, ends with `end_id`, so each has a piece; null and repeated keys are packed like others; an
    empty table gives no rows. Pieces of a sequence lie in it without gaps. Sequence numbers are unique, not consecutive.
    """
    kind = dict(docs.dtypes)[key]
    stop = np.asarray([end_id], "<u4").tobytes()
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    schema = f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_ids(path)
        base = TaskContext.get().partitionId() << SEQUENCE_BITS
        rows: list[tuple] = []
        kinds: list[pa.DataType] = []

        def emit(number: int, pieces: list) -> None:
            at = 0
            for (k, n), start, ids in pieces:
                size = len(ids) // 4
                rows.append((k, start, size, zlib.crc32(ids), n, base + number, at, *([ids] if keep_ids else [])))
                at += size

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows))
            out = pa.RecordBatch.from_arrays([pa.array(cols[0], type=kinds[0]), *[pa.array(c, type=pa.int64()) for c in cols[1:7]], *[pa.array(c, type=pa.binary()) for c in cols[7:]]], names=names)
            rows.clear()
            return out

        packer = SumOfSquares(window, emit, max_open)
        for b in batches:
            kinds = [b.column(0).type]
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encode(t) + stop
                packer.add((k, len(ids) // 4), ids)
                if len(rows) >= 20_000:
                    yield flush()
        packer.join(final=True)
        if rows:
            yield flush()

    return texts(docs, key, text).mapInArrow(run, schema)
