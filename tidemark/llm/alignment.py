"""Alignment of two tokenizers' tokens by byte ranges, with every distinct segment tokenised and aligned once.

Texts are cut before runs of white space that begin with a space or a line end, where neither vocabulary can merge across: `Pair` reads
both vocabularies and cuts at a character only if no token holds it after anything else than white space. Documents become numbers into
their chunk's list of distinct segments. The chunks' lists meet in a table of segments; each of these is tokenised and aligned, its links
count as often as it occurs, and the alignments with their counts go back to the chunks, in which documents are composed.

A chunk is a bounded number of characters of one input partition (or one longer text), so neither a chunk nor a segment's row grows with
the corpus, and a segment that all documents share is one row for each chunk.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.bpe import byte_letters
from tidemark.llm.common import by_bytes, cut, discard, pick

#: Characters of a chunk; a longer text is a chunk of its own.
CHUNK_CHARS = 24_000_000
#: Bits of the number that a chunk or a block has within its partition.
CHUNK_BITS = 28
#: Segments that go to the tokenizers at once, and those of a block, whose id pairs are counted together.
BATCH, BLOCK_SEGMENTS = 4096, 131_072
SPACE, MARK = " ", "▁"
#: White space by any of the tokenizers' definitions.
WHITE = r"\s᠎"


class Pair:
    """Two tokenizers, and the places at which texts may be cut for both.

    The first is byte-level BPE whose pre-tokens are runs of one class with at most one space before them: none goes on from anything to
    white space. The second is piece BPE without pre-tokens, which puts a space before a text.
    """

    def __init__(self, first: str, second: str) -> None:
        self.a = Tokenizer.from_file(first)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        with open(first, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_letters().items()}
        vocab = spec["model"]["vocab"]
        self.a_size = np.zeros(max(self.a.get_vocab(with_added_tokens=True).values()) + 1, np.int64)
        for t, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_size[i] = len(t)  # a letter for each byte
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, SPACE).encode() for i, p in enumerate(pieces)]
        self.b_size = np.asarray([len(x) for x in self.b_bytes], np.int64)
        self.space = [self.b.piece_to_id(MARK)]
        plain = [p.replace(MARK, SPACE) for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        a_tokens = [bytes([back[c] for c in t]).decode("utf-8", "replace") for t in vocab if all(c in back for c in t)]
        pre = spec["pre_tokenizer"]
        by_rule = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        # runs of spaces and single line ends must also come out of the second one as they went in, with one space before them
        kept = self.joined(self.b.encode(" x  y\nz \n")) == b"  x  y\nz \n"
        self.cuts = "".join(c for c in " \n" if by_rule and kept and self.safe(c, a_tokens) and self.safe(c, plain) and (c == SPACE or not any(c in p for p in plain)))
        self.pattern = re.compile(rf"(?<=[^{WHITE}])(?=[{self.cuts}])") if self.cuts else None
        #: the same for texts without other white space, and faster
        self.simple = re.compile(r"[ \n]+[^ \n]+|[ \n]+") if self.cuts == " \n" else None
        self.other = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

    @staticmethod
    def safe(c: str, tokens: list[str]) -> bool:
        """No token holds c after a character that is not white space."""
        across = re.compile(rf"[^{WHITE}]{re.escape(c)}")
        return not any(across.search(t) for t in tokens)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join([self.b_bytes[i] for i in ids])

    def segments(self, text: str) -> list[str]:
        """Space and text, cut."""
        s = SPACE + text
        if self.simple is not None and not self.other.search(s):
            return self.simple.findall(s)
        return self.pattern.split(s) if self.pattern else [s]

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """ids of both, segment by segment. The second tokenizer puts a space first: segments that begin with one go without it; to others
        it adds a token of its own, which no piece joins with a line end, and which is taken off."""
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b = self.b.encode([s[1:] if s[0] == SPACE else s for s in segments], num_threads=1)
        # a segment of one space leaves nothing to encode; it is the mark by itself
        return a, [self.space if s == SPACE else x if s[0] == SPACE else x[1:] for s, x in zip(segments, b)]

    def encode_joined(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """ids of both for segments of which none but the last ends in white space, as one text: they were cut where nothing merges across.
        None if the second one's tokens do not give the bytes back."""
        text = "".join(segments)
        if text[0] != SPACE or len(text) < 2:
            a, b = self.encode(segments)
            a, b = [i for x in a for i in x], [i for x in b for i in x]
        else:
            a, b = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:])
        return (np.asarray(a, np.int64), np.asarray(b, np.int64)) if self.joined(b) == text.encode() else None

    def align(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """(whole, n_a, groups, links, n_links) of every segment; links are a * 2**32 + b, those of the first segment first. Whole: the
        second tokenizer's tokens give its bytes back; only then it has tokens."""
        whole = np.ones(len(segments), bool)
        loose = [k for k, s in enumerate(segments) if s[-1].isspace() or s[-1] == "\u180e"]
        tight = [k for k in range(len(segments)) if k not in set(loose)] if loose else list(range(len(segments)))
        ids: list = [None] * len(segments)
        got = self.encode_joined([segments[k] for k in tight]) if tight else None
        if got is None:
            loose, tight = list(range(len(segments))), []
        for k, a, b in zip(loose, *self.encode([segments[k] for k in loose])):
            whole[k] = self.joined(b) == segments[k].encode()
            ids[k] = (a, b) if whole[k] else ([], [])
        order = [*tight, *[k for k in loose if whole[k]]]
        none = np.empty(0, np.int64)
        a = np.concatenate([got[0] if tight else none, *[np.asarray(ids[k][0], np.int64) for k in loose if whole[k]]])
        b = np.concatenate([got[1] if tight else none, *[np.asarray(ids[k][1], np.int64) for k in loose if whole[k]]])
        ends = np.cumsum([len(segments[k].encode()) for k in order])
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        every = np.union1d(end_a, end_b)  # a pair of tokens overlaps in one stretch, which one of these ends
        links = a[np.searchsorted(end_a, every)] << 32 | b[np.searchsorted(end_b, every)]
        cut_at = lambda inner, outer: np.concatenate([[0], np.searchsorted(inner, outer, side="right")])
        lists = lambda values, inner, outer: pa.ListArray.from_arrays(pa.array(cut_at(inner, outer).astype(np.int32)), values)
        named = [pc.binary_join(lists(pa.array(x).cast(pa.string()), e, common), ",") for x, e in ((a, end_a), (b, end_b))]
        groups = pc.binary_join(lists(pc.binary_join_element_wise(*named, "|"), common, ends), ";").cast(pa.string())
        n_a, n_links, at = np.diff(cut_at(end_a, ends)), np.diff(cut_at(every, ends)), cut_at(every, ends)
        if not loose:
            return whole, n_a, groups, links, n_links
        back = np.full(len(segments), len(order))  # the place past the last one has nothing
        back[order] = np.arange(len(order))
        n_a, n_links = np.append(n_a, 0)[back], np.append(n_links, 0)[back]
        groups = pa.concat_arrays([groups, pa.array([""])]).take(pa.array(back))
        first = np.repeat(at[back] - np.concatenate([[0], np.cumsum(n_links)[:-1]]), n_links)
        return whole, n_a, groups, links[first + np.arange(len(first))], n_links


@lru_cache(maxsize=2)
def pair(first: str, second: str) -> Pair:
    return Pair(first, second)


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, all lowest bytes first, then the next ones, of which the upper ones are mostly zeros, compressed."""
    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def chunked(docs: DataFrame, first: str, second: str, key: str, text: str, chunk_chars: int) -> DataFrame:
    """Rows of two kinds: documents (chunk, key, places) and segments (chunk, place, seg, n)."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(first, second)
        number, chars = TaskContext.get().partitionId() << CHUNK_BITS, 0
        places: defaultdict[str, int] = defaultdict()
        places.default_factory = places.__len__
        used = np.zeros(1 << 16, np.int64)
        schema = None

        def distinct() -> Iterator[pa.RecordBatch]:
            segs, counts = list(places), used
            for i in range(0, len(segs), 100_000):
                part = segs[i : i + 100_000]
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), pa.nulls(n, schema), pa.nulls(n, pa.binary()), pa.array(range(i, i + n), pa.int32()), pa.array(part, pa.string()), pa.array(counts[i : i + n])], names=["chunk", key, "doc", "place", "seg", "n"])

        for b in batches:
            schema = b.column(0).type
            chunks, made = [], []
            late: list[pa.RecordBatch] = []
            for t in b.column(1).to_pylist():
                at = np.fromiter(map(places.__getitem__, p.segments(t)), np.uint32) if t else np.empty(0, np.uint32)
                if len(places) > len(used):
                    used = np.concatenate([used, np.zeros(len(places), np.int64)])
                if len(at):
                    used += np.bincount(at, minlength=len(used))[: len(used)] if len(at) * 8 > len(used) else 0
                    if len(at) * 8 <= len(used):
                        np.add.at(used, at, 1)
                chunks.append(number)
                made.append(packed(at))
                chars += len(t or "")
                if chars >= chunk_chars:
                    late += distinct()
                    number, chars = number + 1, 0
                    places.clear()
                    used = np.zeros(1 << 16, np.int64)
            n = len(chunks)
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), b.column(0), pa.array(made, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names=["chunk", key, "doc", "place", "seg", "n"])
            yield from late
        if places:
            yield from distinct()

    return by_bytes(docs).mapInArrow(run, f"chunk bigint, `{key}` {kind}, doc binary, place int, seg string, n bigint")


def aligned_segments(segs: DataFrame, first: str, second: str) -> DataFrame:
    """Rows of two kinds: segments (block, seg, whole, the first tokenizer's count, groups, links as 64-bit numbers; without tokens where
    `whole` is false) and id pairs (block, a, b, w) with how often a block's segments hold them linked in the whole corpus."""
    names = ["block", "seg", "whole", "n_a", "groups", "links", "a", "b", "w"]
    types = [pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(first, second)
        block, rows = TaskContext.get().partitionId() << CHUNK_BITS, 0
        codes: list[np.ndarray] = []
        weights: list[np.ndarray] = []

        def batch(n: int, **cols: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), *[cols.get(c, pa.nulls(n, t)) for c, t in zip(names[1:], types[1:])]], names=names)

        def counts() -> pa.RecordBatch:
            code, at = np.unique(np.concatenate(codes), return_inverse=True)
            w = np.zeros(len(code), np.int64)
            np.add.at(w, at, np.concatenate(weights))
            codes.clear(), weights.clear()
            return batch(len(code), a=pa.array((code >> 32).astype(np.int32)), b=pa.array((code & 0xFFFFFFFF).astype(np.int32)), w=pa.array(w))

        for r in batches:
            for k in range(0, r.num_rows, BATCH):
                part = r.slice(k, BATCH)
                n = part.num_rows
                whole, n_a, groups, links, n_links = p.align(part.column(0).to_pylist())
                ends = np.concatenate([[0], np.cumsum(n_links)]) * 8
                packed = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(links))])
                yield batch(n, seg=part.column(0), whole=pa.array(whole), n_a=pa.array(n_a.astype(np.int32)), groups=groups, links=packed)
                codes.append(links)
                weights.append(np.repeat(np.asarray(part.column(1)), n_links))
                rows += n
                if rows >= BLOCK_SEGMENTS:
                    yield counts()
                    block, rows = block + 1, 0
        if codes:
            yield counts()

    return segs.mapInArrow(run, "block bigint, seg string, whole boolean, n_a int, groups string, links binary, a int, b int, w bigint")


def lost_counts(docs: DataFrame, segs: DataFrame, table: DataFrame) -> DataFrame:
    """(seg, lost): how often segments occur in documents that hold one whose tokens do not give its bytes back; those have no tokens."""
    bad = table.where("not whole").select(F.col("seg").alias("_bad"))
    at = segs.join(bad, segs["seg"] == bad["_bad"]).groupBy("chunk").agg(F.collect_list("place").alias("bad"))  # of a chunk's places at most
    hit = docs.join(at, "chunk").select("chunk", "doc", "bad")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, d, bad in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                at = unpacked(d)
                if np.isin(at, np.asarray(bad, np.uint32)).any():
                    place, n = np.unique(at, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), c, np.int64)), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int64))], names=["chunk", "place", "less"])

    gone = by_bytes(hit).mapInArrow(run, "chunk bigint, place int, less bigint").groupBy("chunk", "place").agg(F.sum("less").alias("less"))
    return gone.join(segs.select("chunk", "place", "seg"), ["chunk", "place"]).groupBy("seg").agg(F.sum("less").alias("lost"))


def lost_links(table: DataFrame, lost: DataFrame) -> DataFrame:
    """(a, b, w) with negative w: the links in documents without tokens."""
    gone = table.where("whole").select("seg", "links").join(lost, "seg").select("links", "lost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            links = [np.frombuffer(x, np.int64) for x in r.column(0).to_pylist()]
            code = np.concatenate([*links, np.empty(0, np.int64)])
            w = -np.repeat(np.asarray(r.column(1)), [len(x) for x in links])
            yield pa.RecordBatch.from_arrays([pa.array((code >> 32).astype(np.int32)), pa.array((code & 0xFFFFFFFF).astype(np.int32)), pa.array(w)], names=["a", "b", "w"])

    return gone.mapInArrow(run, "a int, b int, w bigint")


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, c, best): the corpus-wide links of every id pair, and whether no other first id has more with that second id."""
    counts = cut(links.groupBy("a", "b").agg(F.sum("w").alias("c")), "pairs", clean=True)
    top = counts.groupBy("b").agg(F.max("c").alias("top"))
    return counts.join(top, "b").select("a", "b", "c", (F.col("c") == F.col("top")).cast("int").alias("best"))


def valued(segs: DataFrame, worth: DataFrame) -> DataFrame:
    """Segments with the sum of their links' counts and the number of best ones. segs: rows of `aligned_segments`; worth: (block, a, b, c,
    best) for all pairs of a block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        code = np.asarray(right.column("a"), np.int64) << 32 | np.asarray(right.column("b"), np.int64)
        order = np.argsort(code)
        code, c, best = code[order], np.asarray(right.column("c"))[order], np.asarray(right.column("best"), np.int64)[order]
        packed = left.column("links").combine_chunks()
        at = np.searchsorted(code, np.frombuffer(b"".join(packed.to_pylist()), np.int64))
        ends = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(packed), np.int64) // 8)])
        sums = [np.diff(np.concatenate([[0], np.cumsum(x[at])])[ends]) for x in (c, best)]
        return pa.table([left.column("seg"), left.column("n_a"), left.column("groups"), pa.array(sums[0]), pa.array(sums[1])], names=["seg", "n_a", "groups", "count_sum", "n_best"])

    return segs.select("block", "seg", "n_a", "groups", "links").groupBy("block").cogroup(worth.groupBy("block")).applyInArrow(run, "seg string, n_a int, groups string, count_sum bigint, n_best bigint")


def align_documents(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS, keep_groups: bool = False) -> DataFrame:
    """One row per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and the groups themselves, if asked for).

    `first` and `second` are the tokenizers' files. Null and empty texts, and texts whose joined token bytes differ from a space and the
    text, have no tokens: zeros, no groups, and no part in any count. Null and repeated keys are rows of their own; equal texts have equal
    values; other columns are not read; an empty table has no rows. Texts of any length are aligned whole: one without white space is one
    segment.
    """
    base = pick(docs, key, text).withColumn(text, F.col(text).cast("string"))
    kind = dict(base.dtypes)[key]
    chunks = cut(chunked(base, first, second, key, text, chunk_chars), "chunks", clean=True, codec="zstd")
    rows = chunks.where("place is null").select("chunk", key, "doc")
    segs = base.sparkSession.read.schema(chunks.schema).parquet(chunks._written).where("place is not null").select("chunk", "place", "seg", "n")
    both = cut(aligned_segments(by_bytes(segs.groupBy("seg").agg(F.sum("n").alias("w"))), first, second), "segments", clean=True)
    again = base.sparkSession.read.schema(both.schema).parquet(both._written)
    table, counted = both.where("seg is not null"), again.where("seg is null").select("block", "a", "b", "w")
    weighed = counted.select("a", "b", "w")
    if table.where("not whole").limit(1).count():
        lost = cut(lost_counts(rows, segs, table), "lost")
        weighed = weighed.unionByName(lost_links(table, lost))
    pairs = cut(pair_counts(weighed), "weights", clean=True)
    worth = counted.select("block", "a", "b").join(pairs, ["a", "b"]).select("block", "a", "b", "c", "best")
    known = cut(valued(table, worth), "known", clean=True, codec="zstd")
    discard(both)
    back = cut(segs.select("chunk", "place", "seg").join(known, "seg").drop("seg"), "back", clean=True, codec="zstd")
    discard(known)
    names = [key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["groups"] * keep_groups

    def compose(left: pa.Table, right: pa.Table) -> pa.Table:
        n, text = right.num_rows, right.column("groups").combine_chunks()
        commas, parts = (np.asarray(pc.count_substring(text, c), np.int64) for c in (",", ";"))
        whole = np.asarray(pc.binary_length(text)) > 0
        n_a, n_groups = np.asarray(right.column("n_a"), np.int64), np.where(whole, parts + 1, 0)
        # a group of i and j tokens has i + j - 2 commas, and i + j - 1 pairs of them overlap
        numbers = (n_a, commas + 2 * n_groups - n_a, n_groups, commas + n_groups, np.asarray(right.column("n_best")), np.asarray(right.column("count_sum")))
        row = np.empty(n, np.int64)  # of a place
        row[np.asarray(right.column("place"))] = np.arange(n)
        sums = np.column_stack(numbers)
        made, shas, texts = np.zeros((left.num_rows, 6), np.int64), [], []
        for i, d in enumerate(left.column("doc").to_pylist()):
            at = row[unpacked(d)]
            if not len(at) or not whole[at].all():
                shas.append("")
                texts.append("")
                continue
            made[i] = sums[at].sum(axis=0)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), text.take(pa.array(at))), ";")[0].as_py()
            shas.append(hashlib.sha256(joined.encode()).hexdigest())
            texts.append(joined if keep_groups else "")
        return pa.table([left.column(key), *[pa.array(made[:, i]) for i in range(6)], pa.array(shas, pa.string()), *([pa.array(texts, pa.string())] if keep_groups else [])], names=names)

    schema = f"`{key}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string" + ", groups string" * keep_groups
    return rows.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(compose, schema)
