"""Conversations as training windows: chat template, escaped control strings, loss spans.

Running sums of the turns' tokens place every turn on its conversation's line of tokens. The line is cut into blocks at turns; within a
block, spans of whole turns are taken as long as they fit the budget. A window is the conversation's system turn, the turns just before
the span as far as the history's budget goes, and the span. Text of the span's assistant turns is the loss; what is repeated is masked, so
that each turn is trained on once. A block needs no more than itself, the system turn and the halo of turns before it, so that a
conversation of any length spreads over tasks, and a task streams its blocks one by one.

Template: `<|im_start|>role\\ntext<|im_end|>\\n`. Escapes: of every `<`, backslashes, `|` in a text there is one backslash more, so `<|`
stands in no escaped text; in a role, backslash and newline are escaped as well.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import by_bytes, cut, pick
from tidemark.llm.ordered import numbered

#: Tokens of a window, of the history that it repeats, and budgets in a block.
BUDGET, HISTORY, BLOCK_WINDOWS = 2048, 512, 64
OPEN, CLOSE, TARGET, SYSTEM = "<|im_start|>", "<|im_end|>\n", "assistant", "system"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
WINDOW_SCHEMA = "first bigint, last bigint, n_repeated int, n_tokens bigint, oversize boolean, text string, loss array<struct<start:bigint,end:bigint>>"
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turn_text(role: str, text: str) -> tuple[str, int]:
    """A formatted turn, and where its text begins in it."""
    head = f"{OPEN}{escape_role(role)}\n"
    return f"{head}{escape(text)}{CLOSE}", len(head)


@lru_cache(maxsize=2)
def plain_tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file; special tokens' strings in texts are ordinary text."""
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True
    return t


class Turn:
    __slots__ = ("place", "role", "shown", "at", "start", "size")

    def __init__(self, place: int, role: str, text: str, start: int, size: int) -> None:
        self.place, self.role, self.start, self.size = place, role, start, size
        self.shown, self.at = turn_text(role, text)


def window_row(repeated: list[Turn], span: list[Turn], budget: int) -> tuple:
    """A window as a row of WINDOW_SCHEMA."""
    loss, at = [], sum(len(t.shown) for t in repeated)
    for t in span:
        if t.role == TARGET:
            loss.append({"start": at + t.at, "end": at + len(t.shown) - len(CLOSE)})
        at += len(t.shown)
    n = sum(t.size for t in repeated) + sum(t.size for t in span)
    return span[0].place, span[-1].place, len(repeated), n, n > budget, "".join([t.shown for t in (*repeated, *span)]), loss


def block_windows(turns: Iterable[tuple[Turn, bool]], budget: int, history: int) -> Iterator[tuple]:
    """The windows of a block's turns, which come in order; those marked False are the system turn and the halo, which open no span."""
    system: Turn | None = None
    past: list[Turn] = []
    repeated: list[Turn] = []
    span: list[Turn] = []
    taken = 0  # tokens of what is repeated
    for t, new in turns:
        if t.place == 0 and t.role == SYSTEM:
            system = t
        if new:
            if span and taken + t.start + t.size - span[0].start > budget:
                yield window_row(repeated, span, budget)
                span = []
            if not span:
                kept = [system] if system is not None and t is not system else []
                room = budget - t.size - sum(x.size for x in kept)
                back = [x for x in past if t.start - x.start <= min(history, room)]
                repeated = kept + back
                taken = sum(x.size for x in repeated)
            span.append(t)
        if t is not system:
            past.append(t)
            while past and t.start + t.size - past[0].start > history:
                past.pop(0)
    if span:
        yield window_row(repeated, span, budget)


def chat_windows(turns: DataFrame, vocabulary: str, budget: int = BUDGET, history: int = HISTORY, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per window: conv, first and last (places of the span's turns in the conversation, from 0), n_repeated (turns before the
    span), n_tokens, oversize (a single turn that is longer than the budget allows; it is never cut), text, loss (code points).

    Turns stand by number, null numbers first, equal numbers by role and text; repeated rows are turns of their own. Null roles and texts
    are empty. Null conversation ids are one conversation. An empty table has no windows. `vocabulary` is the tokenizer file that counts
    tokens; a turn's count is that of the formatted turn, marks and escapes included.
    """
    base = pick(turns, conv, turn, role, text).select(F.col(conv), F.col(turn), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))

    def tokens(b: pa.RecordBatch) -> list[int]:
        t = plain_tokenizer(vocabulary)
        return [len(t.encode(turn_text(r, x)[0], add_special_tokens=False)) for r, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]

    block = budget * BLOCK_WINDOWS
    placed, _ = numbered(base, conv, [turn, "_role", "_text"], tokens)
    placed = placed.select(F.col(conv).alias("_conv"), "_role", "_text", "_i", "_n", "_start", F.expr(f"_start div {block}").alias("_block"))
    lines = cut(placed, "turns")
    here = lines.withColumn("_new", F.lit(True))
    halo = lines.where(F.col("_start") + history >= (F.col("_block") + 1) * block).withColumn("_block", F.col("_block") + 1).withColumn("_new", F.lit(False))
    later = lines.where("_block > 0").select("_conv", "_block").distinct()
    opening = lines.where((F.col("_i") == 0) & (F.col("_role") == SYSTEM)).select(F.col("_conv").alias("_c"), "_role", "_text", "_i", "_n", "_start")
    system = later.join(opening, later["_conv"].eqNullSafe(opening["_c"])).select("_conv", "_role", "_text", "_i", "_n", "_start", "_block", F.lit(False).alias("_new"))
    # a system turn in the halo of the second block is there as the system turn already
    halo = halo.where(~((F.col("_i") == 0) & (F.col("_role") == SYSTEM)))
    rows = here.unionByName(halo).unionByName(system)
    dealt = rows.repartition("_conv", "_block").sortWithinPartitions("_conv", "_block", "_i", "_new")
    kind = dict(lines.dtypes)["_conv"]
    names = [conv, "first", "last", "n_repeated", "n_tokens", "oversize", "text", "loss"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), _LOSS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        out: list[tuple] = []
        held = 0

        def blocks() -> Iterator[tuple]:
            """(conv, block, turn, new) of every row."""
            for b in batches:
                kinds[:] = [b.column(0).type]
                col = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
                for c, k, r, x, i, s, n, new in zip(col["_conv"], col["_block"], col["_role"], col["_text"], col["_i"], col["_start"], col["_n"], col["_new"]):
                    yield c, k, Turn(i, r, x, s, n), new

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            made = pa.RecordBatch.from_arrays([pa.array(cols[0], type=kinds[0]), *[pa.array(c, type=t) for c, t in zip(cols[1:], types)]], names=names)
            out.clear()
            return made

        source = blocks()
        row = next(source, None)
        while row is not None:
            c, k = row[:2]

            def own() -> Iterator[tuple[Turn, bool]]:
                nonlocal row
                while row is not None and row[:2] == (c, k):
                    yield row[2], row[3]
                    row = next(source, None)

            for w in block_windows(own(), budget, history):
                out.append((c, *w))
                held += len(w[5])
                if held > 1 << 23:
                    held = 0
                    yield flush()
        if out:
            yield flush()

    return by_bytes(dealt).mapInArrow(run, f"`{conv}` {kind}, {WINDOW_SCHEMA}")


def read_turns(text: str) -> list[tuple[str, str]]:
    """The (role, text) of all turns of a formatted window."""
    out = []
    for part in text.split(OPEN)[1:]:
        role, _, rest = part.partition("\n")
        if not rest.endswith(CLOSE):
            raise ValueError("a turn has no end")
        out.append((unescape_role(role), unescape(rest[: -len(CLOSE)])))
    return out


def read_digests(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the windows of each conversation hold: turns that are not repeats, and the text under the loss spans.

    A digest over a whole conversation has to meet its windows in order, so they stream through one task for each conversation, one window
    in memory at a time.
    """
    dealt = windows.select(conv, "first", "n_repeated", "text", "loss").repartition(conv).sortWithinPartitions(conv, "first")
    kind = dict(windows.dtypes)[conv]
    names = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        kinds: list[pa.DataType] = []
        state: list | None = None

        def end() -> None:
            if state is not None:
                rows.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows))
            made = pa.RecordBatch.from_arrays([pa.array(cols[0], type=kinds[0]), *[pa.array(c, type=t) for c, t in zip(cols[1:], types)]], names=names)
            rows.clear()
            return made

        for b in batches:
            kinds[:] = [b.column(0).type]
            for c, n, text, loss in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if state is None or state[0] != c:
                    end()
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = read_turns(text)[n:]
                state[1] += len(turns)
                state[2].update("".join([f"{r}\n{x}\n" for r, x in turns]).encode())
                for s in loss:
                    x = unescape(text[s["start"] : s["end"]])
                    state[3] += len(x)
                    state[4].update(x.encode())
                state[5] += len(text)
            if len(rows) >= 10_000:
                yield flush()
        end()
        if rows:
            yield flush()

    return by_bytes(dealt).mapInArrow(run, f"`{conv}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
