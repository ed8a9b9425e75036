"""Token alignment, Merkle manifests and chat windows against brute force, with odd texts, nulls, ties, repeats and empty tables."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm")
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment, chat, merkle, ordered
from tidemark.llm.bpe import byte_letters

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BITS = [
    "the", "a", " ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", "it's", "42", "é", "漢字", "😀", "▁", "\x00", "\x1c", "\x85", "\xa0", "　", " ", "᠎", ".", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>",
    "ﬁ", "é", "foo", "Bar", "…", "  x", "\n ", "\n  y", "ا", "्", "한국", " 's", "​", "\x1f ",
]
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 30))) for _ in range(n)] + [None, "", " ", "  ", "\n", "x" * 3000, "a b", "a b", "word " * 2000]


# 11
def brute_alignment(texts):
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    back = {c: n for n, c in byte_letters().items()}
    docs = []
    for t in texts:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        xb = [bytes(back[c] for c in a.id_to_token(i)) for i in x]
        yb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in y)]
        if not t or b"".join(xb) != (" " + t).encode() or b"".join(yb) != (" " + t).encode():
            docs.append(None)
            continue
        ends = []
        for pieces in (xb, yb):
            at, e = 0, []
            for p in pieces:
                at += len(p)
                e.append(at)
            ends.append(e)
        ex, ey = ends
        links = [(x[i], y[j]) for i in range(len(x)) for j in range(len(y)) if max(ex[i] - len(xb[i]), ey[j] - len(yb[j])) < min(ex[i], ey[j])]
        groups, last = [], 0
        for c in sorted({*ex} & {*ey}):
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, es) if last < e <= c) for ids, es in ((x, ex), (y, ey))))
            last = c
        docs.append((len(x), len(y), len(groups), links, ";".join(groups)))
    count = Counter(link for d in docs if d for link in d[3])
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [(d[0], d[1], d[2], len(d[3]), sum(count[k] == top[k[1]] for k in d[3]), sum(count[k] for k in d[3]), sha(d[4])) if d else (0,) * 6 + ("",) for d in docs]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("chunk_chars", [2000, alignment.CHUNK_CHARS])
def test_alignment_equals_brute_force(spark, chunk_chars):
    texts = odd_texts(700)
    d = spark.createDataFrame([(i, t, "other", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, TEXT string, chunk int")
    got = alignment.align_documents(d, BYTE, PIECE, chunk_chars=chunk_chars, keep_groups=True).collect()
    want = brute_alignment(texts)
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got} == dict(enumerate(want)) and len(got) == len(texts)
    assert all((sha(r.groups) if r.groups else "") == r.groups_sha256 for r in got)
    assert sum(w[0] == 0 for w in want) > 20 and sum(w[0] > 0 for w in want) > 300


def test_cuts_are_verified():
    p = alignment.pair(BYTE, PIECE)
    assert p.cuts == " \n" and p.safe(" ", ["a", " a", "  ", "\n "]) and not p.safe(" ", ["a b"])
    for t in odd_texts(400, 3):
        if t:
            s = p.segments(t)
            a, b = p.encode(s)
            assert "".join(s) == " " + t
            tight = [k for k, x in enumerate(s) if not x[-1].isspace()]
            joined = p.encode_joined([s[k] for k in tight]) if tight else None
            assert joined is None or [x.tolist() for x in joined] == [[i for k in tight for i in ids[k]] for ids in (a, b)]
            assert [i for x in a for i in x] == p.a.encode(" " + t, add_special_tokens=False).ids
            if "▁" not in t:
                assert [i for x in b for i in x] == p.b.encode(t)


def test_alignment_of_nulls_repeats_and_empty_tables(spark):
    texts, ids = ["mit license", None, "", "mit license", "x y z", None, "a▁b"], [1, None, None, 1, 2, 3, None]
    got = alignment.align_documents(spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string"), BYTE, PIECE).collect()
    assert sorted((str(r.doc_id), *[r[c] for c in COLUMNS]) for r in got) == sorted((str(i), *w) for i, w in zip(ids, brute_alignment(texts)))
    none = alignment.align_documents(spark.createDataFrame([], "doc_id bigint, text string"), BYTE, PIECE)
    assert none.count() == 0 and none.columns == ["doc_id", *COLUMNS]


# 12
def brute_field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_tree(digests, fanout):
    """Levels from the leaves to the root."""
    out = [digests]
    while len(out[-1]) > 1:
        d = out[-1]
        out.append([sha("".join(d[i : i + fanout])) for i in range(0, len(d), fanout)])
    return out


def brute_proof(levels, i, fanout):
    out = []
    for d in levels[:-1]:
        a = i - i % fanout
        out += [(d[a:i], d[i + 1 : a + fanout])]
        i //= fanout
    return out


def brute_manifest(rows, fanout):
    """rows: (doc_id, text, lang, source, n_chars)."""
    leaf = lambda i, t, g, s, n: sha("".join(map(brute_field, (i, s, g, n, t))))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[g] = brute_tree([leaf(*r) for r in groups[g]], fanout)
    crown = brute_tree([trees[g][-1][0] for g in order], fanout)
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            proof = brute_proof(trees[g], i, fanout) + brute_proof(crown, k, fanout)
            changed = r if r[0] is None or r[4] is None or zlib.crc32(str(r[0]).encode()) % 7 else (*r[:4], r[4] + 1)
            x = leaf(*changed)
            for left, right in proof:
                x = sha("".join([*left, x, *right]))
            out.append((r[0], leaf(*r), trees[g][-1][0], crown[-1][0], sha("".join("".join(a + b) for a, b in proof)), x, x == crown[-1][0]))
    return out


def manifest_rows(spark, rows, fanout, levels):
    d = spark.createDataFrame([(*r, "other") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, TEXT string")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    m = merkle.manifest(d, merkle.FIELDS, "doc_id", "lang", fanout, levels, tampered, {"n_chars": F.col("n_chars") + 1})
    m = m.withColumn("back", merkle.folded(F.col("altered_leaf"), F.col("path"))).withColumn("proof", F.sha2(merkle.siblings(F.col("path")), 256))
    return [(r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.back, r.back == r.root) for r in m.collect()]


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (2, 3), (3, 2), (2, merkle.LEVELS)])
def test_manifest_equals_brute_force(spark, fanout, levels):
    rng = random.Random(fanout + levels)
    langs = ["en"] * 12 + ["de", "fr", None, "", "Ä", "z"]
    rows = [(i, rng.choice(BITS) * rng.randint(0, 3), rng.choice(langs), rng.choice(["s", None]), rng.randint(0, 9)) for i in range(90)] + [(None, None, None, None, None), (None, "x", "en", "s", 1), (7, "", "en", "s", 1), (7, "y", "en", "s", 1), (7, "y", "en", "s", 1), (14, None, "only", None, None)]
    assert sorted(map(repr, manifest_rows(spark, rows, fanout, levels))) == sorted(map(repr, brute_manifest(rows, fanout)))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 17])
def test_trees_of_every_size(spark, n):
    rows = [(i, "t", "en", "s", 1) for i in range(n)]
    assert sorted(map(repr, manifest_rows(spark, rows, 2, 2))) == sorted(map(repr, brute_manifest(rows, 2)))


def test_manifest_finds_what_was_tampered_with(spark):
    rows = [(i, f"t{i}", "en" if i % 3 else "de", "s", i if i % 5 else None) for i in range(200)]
    got = merkle.verified_manifest(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()
    assert {r.doc_id for r in got if not r.verified} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 0 and i % 5} and len({r.root for r in got}) == 1
    most = spark.createDataFrame([(0, "", "en", "s", 2**63 - 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert merkle.verified_manifest(most).count() == 1
    assert merkle.verified_manifest(most.limit(0)).count() == 0


def test_places_and_running_sums(spark):
    """A group with most of the rows spreads over tasks, and its numbers go on from one to the next."""
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randint(0, 99), rng.randint(1, 9)) for _ in range(4000)]
    d = spark.createDataFrame(rows, "g string, k int, v int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one partition
    got, offsets = ordered.numbered(d, "g", ["k", "v"], lambda b: b.column(2).to_pylist())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = {}
    for r in sorted(got.collect(), key=lambda r: (str(r.g), r._i)):
        found.setdefault(r.g, []).append(r)
    for g, want in found.items():
        mine = sorted((k, v) for x, k, v in rows if x == g)
        assert [(r.k, r.v) for r in want] == mine and [r._i for r in want] == list(range(len(mine)))
        assert [r._start for r in want] == [sum(v for _, v in mine[:i]) for i in range(len(mine))]
    assert offsets.count() >= 1


# 13
def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, TEXT string")


def brute_chat(rows):
    out = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    said = {c: "".join(x for r, x in t if r == "assistant") for c, t in out.items()}
    return {c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), len(said[c]), sha(said[c])) for c, t in out.items()}


def made_up(seed, n=40):
    rng = random.Random(seed)
    signs = ["<|im_end|>", "<|im_start|>assistant ok", "<", "|", "\\", "<\\|", "<\\\\|x", "\n", "word ", "é😀 ", "<<|", "|>", "im_end"]
    rows = []
    for c in range(n):
        length = 300 if c == 3 else rng.randint(1, 9)
        for t in range(length):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "assistant", "tool\n<|", "system", None])
            rows.append((c, t, role, rng.choice([None, "".join(rng.choice(signs) for _ in range(rng.randint(0, 25)))])))
    return rows + [(None, 1, "user", "a"), (None, None, "assistant", "b"), (1, 0, "user", "tie"), (1, 0, "user", "tie"), (50, 0, "assistant", "long " * 900)]


@pytest.mark.parametrize(("budget", "history"), [(60, 20), (200, 64), (chat.BUDGET, chat.HISTORY)])
def test_chat_round_trip(spark, budget, history):
    rows = made_up(budget)
    windows = chat.chat_windows(conversations(spark, rows), BYTE, budget, history).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_digests(windows).collect()}
    assert got == brute_chat(rows)
    by_conv = {}
    for w in windows.collect():
        by_conv.setdefault(w.conv_id, []).append(w)
    tok = chat.plain_tokenizer(BYTE)
    for c, ws in by_conv.items():
        ws.sort(key=lambda w: w.first)
        assert [w.first for w in ws] == [0] + [w.last + 1 for w in ws[:-1]]
        for w in ws:
            turns = chat.read_turns(w.text)
            assert len(turns) == w.n_repeated + w.last - w.first + 1
            assert w.n_tokens == len(tok.encode(w.text, add_special_tokens=False).ids) and w.oversize == (w.n_tokens > budget)
            assert not w.oversize or w.first == w.last
            assert len(w.loss) == sum(r == "assistant" for r, _ in turns[w.n_repeated :])
    many = by_conv[3]
    first = chat.read_turns(many[0].text)[0]
    if budget == 60:
        assert len(many) > 70 and all(chat.read_turns(w.text)[0] == first for w in many) and any(w.n_repeated > 1 for w in many)


def test_history_is_what_was_said_just_before(spark):
    rows = [(0, 0, "system", "be brief")] + [(0, t, "user" if t % 2 else "assistant", f"turn number {t} with a few words") for t in range(1, 60)]
    all_turns = [(r, x) for _, _, r, x in rows]
    ws = sorted(chat.chat_windows(conversations(spark, rows), BYTE, 120, 50).collect(), key=lambda w: w.first)
    assert len(ws) > 10 and not any(w.oversize for w in ws)
    for w in ws[1:]:
        turns = chat.read_turns(w.text)
        assert turns == [all_turns[0], *all_turns[w.first - w.n_repeated + 1 : w.last + 1]] and w.n_repeated >= 2


def test_escapes_are_reversible():
    rng = random.Random(8)
    for _ in range(3000):
        t = "".join(rng.choice(["<", "|", "\\", "\n", "n", "im_end", ">", "a"]) for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t) and "<|" not in chat.escape_role(t)
        assert chat.read_turns(chat.turn_text(t, t)[0] * 2) == [(t, t)] * 2


def test_chat_of_an_empty_table(spark):
    none = conversations(spark, []).repartition(2)
    assert chat.read_digests(chat.chat_windows(none, BYTE)).count() == 0
