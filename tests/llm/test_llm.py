"""The training-data operators against brute force, round trips and held-out labels, with nulls, ties, repeats and empty tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm")
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import bpe, licenses, mpeg, ngramjoin, packing, pii, quality, sharding, vectors, warc
from tidemark.llm.automaton import SuffixAutomaton
from tidemark.llm.common import pick
from tidemark.llm.graph import components

VOCAB = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, TEXT string, score double"
ODD = [None, "", " ", "x", "\x00\x1c", "Ünïcödé ΑΣ 漢字 😀", "a" * 5000, "word " * 3000, "it's <|endoftext|> 42's", "   é́"]


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "other", 0.5) for i, t in zip(ids, texts)], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice(["an", "the", "re", "st", "o", "li"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 120))) for _ in range(60)]
    near = []
    for t in base[:20]:
        for _ in range(4):
            w = t.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(words)
            near.append(" ".join(w))
    return base + near + base[:10] + ODD


def test_automaton_finds_all_substrings():
    seqs = ["abcbc", "bcab", "abcbc", ""]
    m = SuffixAutomaton()
    for s in seqs:
        m.add(s)
    subs = {s[i:j] for s in seqs for i in range(len(s)) for j in range(i, len(s) + 1)}
    for n in range(5):
        for t in map("".join, itertools.product("abc", repeat=n)):
            assert (m.find(t) >= 0) == (t in subs or not t)


# 1
def brute_phrases(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(hits), min([h[0] for h in hits], default=None), max([h[0] for h in hits], default=None), sorted({h[1] for h in hits})


def test_license_phrases_and_spans(spark, corpus):
    rng = random.Random(3)
    mix = "gnu general public license apache cc by mit the The LICENSE version é".split()
    texts = corpus + [" ".join(rng.choice(mix) for _ in range(60)) for _ in range(40)] + [licenses.TEMPLATES["mit-text"] + " and more", "X " + licenses.TEMPLATES["bsd-2-clause"].replace("binary", "other")]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_phrases(t)
        assert 0 <= r.score <= 1 and set(r.base_labels) <= set(r.labels)
    full, part = got[len(texts) - 2], got[len(texts) - 1]
    assert "mit-text" in full.labels and max(s.cover for s in full.spans) == 1.0
    assert "bsd-2-clause" in part.labels and 0.6 < max(s.cover for s in part.spans) < 1.0


def test_license_labels_that_only_the_method_finds():
    scan = licenses.scanner().scan
    for name in ("mit-text", "zlib-text", "isc-text", "unlicense-text", "lgpl-header", "mpl-2.0-header", "cc0-notice"):
        words = licenses.TEMPLATES[name].split()
        edited = " ".join("changed" if i % 19 == 18 else w for i, w in enumerate(words))
        got = scan(f"some words before {edited} and after")
        assert not got["base_labels"] and got["labels"] == [name] and 0.6 <= got["score"] < 1.0, name
        assert scan(f"{edited} between {edited}")["spans"][1]["start"] > scan(edited)["spans"][0]["end"] - 1


def test_chains_keep_several_places_open():
    s = licenses.LicenseScanner({}, {"t": "a b c d e f g h a b c d i j k l"}, min_run=4, max_gap=6)
    one = s.scan("a b c d x e f g h y a b c d i j k l")["spans"]
    assert [(x["start"], x["end"], x["cover"]) for x in one] == [(0, 18, 1.0)]
    late = s.scan("a b c d x i j k l")["spans"]  # the later place of the first run is the one that goes on
    assert s.scan("a b c d x i j k l")["score"] == 0.5 and not late
    assert s.scan("a b c d x e f g h")["score"] == 0.5


# 2
KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    out = []
    for r, (k, rx) in enumerate(KINDS):
        for m in re.finditer(rx, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]:
                out.append((m.start(), r, m.end()))
    return ",".join(f"{KINDS[r][0]}:{a}:{b}" for a, r, b in sorted(out))


def test_pii_base(spark, corpus):
    rng = random.Random(1)
    noise = [a + b for a, b in itertools.product(["4111111111111111", "1.2.3.4", "999.1.1.1.5", "+1 (555) 123-4567", "a@b.cc@d.ee_f@g.hh", "4111 1111-1111 1111", "0300.1.1.1", "12", "é", "😀"], ["", " ", ".", "-", "5", "@x.yz"])]
    texts = corpus + ["".join(rng.choice(noise + [" ", "é "]) for _ in range(30)) for _ in range(60)] + ["".join(rng.choice("01.@+- a(é") for _ in range(300)) for _ in range(60)] + ["1." * 20000, "1" * 20000, "a." * 9000 + "@b" + ".c" * 9000]
    for r in pii.pii_spans(docs(spark, texts)).collect():
        want = brute_pii(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k + ":") for k, _ in KINDS]


def test_pii_discovers_by_context(spark):
    texts = [f"call phone: +1 555 123 {1000 + i} now" for i in range(20)] + ["phone: 555-123-9876 please", "size: 1234567", "ratio: 17 of them"] + [f"size: {i} units" for i in range(30)]
    got = {r.doc_id: r.spans for r in pii.pii_spans(docs(spark, texts)).collect()}
    assert got[20] == "id:7:19" and got[21] == "" and got[22] == ""


def test_pii_values_run_to_the_end_of_their_token(spark):
    seeds = [f"call account: +1 555 123 {1000 + i} now" for i in range(40)]
    long = "7" * 6 + "ab12" * 31
    values = ["4821963ABX77", long, "48219-63/AB", "4821 9631 2234 9912 3344 5566 7788 9900 11", "4111111111111111ABX77", "48219631 " * 5 + "4111111111111111", "48219631 " * 5 + "4111111111111111ABX77", "555-123-9876"]
    texts = seeds + [f"my account: {v} please" for v in values]
    got = {r.doc_id: r.spans for r in pii.pii_spans(docs(spark, texts)).collect()}
    for i, v in enumerate(values):
        assert f"id:12:{12 + len(v)}" in got[40 + i].split(","), v
    clean = {r.doc_id: r.text for r in pii.redact(docs(spark, texts), ["doc_id", "text", "n_chars"]).collect()}
    assert all(re.fullmatch(r"my account: (\[ID\]|\[CARD\]) please", clean[40 + i]) for i in range(len(values)))
    assert pii.pii_spans(docs(spark, ["account: " + "1a" * 20000, "account: " + "1 " * 20000, "account: 1" + "." * 40000, "a1: 1" * 9000])).count() == 4


def test_redaction(spark):
    got = {r.doc_id: r for r in pii.redact(docs(spark, ["to a.b@c.de é 1.2.3.4!", None, "plain"]), ["doc_id", "text", "lang", "source", "n_chars"]).collect()}
    assert got[0].text == "to [EMAIL] é [IP]!" and got[0].n_chars == len(got[0].text)
    assert got[1].text is None and got[2].text == "plain"


# 3
def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 64)).astype("f4")
    x[200:260] = x[0] + 0.1 * rng.standard_normal((60, 64))
    x[260:280] = x[260]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [0.0] * 64), (302, [float("nan")] * 64), (303, [None] + [1.0] * 63), (304, []), (305, [1.0, 2.0]), (None, x[0].tolist())]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id bigint, embedding array<float>, label int, EMBEDDING double")
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    comp = list(range(300))
    for _ in range(20):
        comp = [min([comp[i], *[comp[j] for j in np.flatnonzero(near[i])]]) for i in range(300)]
    assert len(got) == len(rows)
    for i in range(300):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), comp[i], comp[i] == i)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(300, 306))
    assert got[None].component_id is None and not got[None].kept
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_in_a_dense_part(spark):
    rng = np.random.default_rng(6)

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    x = unit(np.sqrt(0.9) * unit(rng.standard_normal(64)) + np.sqrt(0.1) * unit(rng.standard_normal((1200, 64))))
    x[600:] = unit(0.957 * x[:600] + np.sqrt(1 - 0.957**2) * unit(rng.standard_normal((600, 64))))
    x = np.concatenate([x, unit(rng.standard_normal((800, 64)))])
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    comp = np.arange(len(x))
    for _ in range(20):
        comp = np.array([min(comp[i], *comp[near[i]]) if near[i].any() else comp[i] for i in range(len(x))])
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")).collect()}
    wrong = [i for i in range(len(x)) if (got[i].n_links, got[i].component_id, got[i].kept) != (near[i].sum(), comp[i], comp[i] == i)]
    assert near.sum() >= 400 and not wrong, (near.sum(), len(wrong))


# 4
def test_packing_is_exact(spark, corpus):
    tok = Tokenizer.from_file(VOCAB)
    out = packing.pack(docs(spark, corpus).repartition(2), VOCAB, window=64, keep_ids=True).collect()
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(corpus)}
    got = {i: [] for i in want}
    fill = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.start)):
        assert len(got[r.doc_id]) == r.start and r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(r.ids)
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
        assert r.length == len(r.ids) // 4
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for parts in fill.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= 64 and at & (at - 1) == 0  # full, or a power of two: no padding


def test_sum_of_squares_choice():
    done = []
    p = packing.SumOfSquares(10, lambda n, pieces: done.append([len(x[2]) // 4 for x in pieces]))
    for size in (6, 6, 3, 4, 4, 1):
        p.add(size, bytes(4 * size))
    assert done[0] == [6, 4] or done[0] == [6, 3, 1]
    p.join(final=True)
    assert sum(map(sum, done)) == 24


# 5
def brute_jaccard(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w)} if 0 < len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)})
    comp = list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    for _ in range(10):
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
    return [len(s) for s in sets], comp


def test_jaccard_join(spark, corpus):
    rng = random.Random(9)
    long = [f"w{i}" for i in range(150)]
    family = [" ".join(w if rng.random() > 0.012 else f"z{rng.randrange(999)}" for w in long) for _ in range(60)]
    texts = corpus + family
    n, comp = brute_jaccard(texts)
    got = {r.doc_id: r for r in ngramjoin.jaccard_components(docs(spark, texts)).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == n
    assert [got[i].component_id for i in range(len(texts))] == comp
    odd = ngramjoin.jaccard_components(docs(spark, ["a b c d", "a b c d", "a b c d", ""], [7, 7, None, 3])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in odd) == [(-1, -1), (3, 3), (7, 7), (7, 7)]
    assert ngramjoin.jaccard_components(docs(spark, [])).count() == 0


def revisions(rng, tag):
    """A, B and C of one size and one prefix by hash: B is too far from A, and C close to B."""
    words = [f"{tag}{i}x{rng.randrange(10**6)}" for i in range(300)]
    first = ngramjoin.prefix_length(298, 90)
    prefix = np.sort(ngramjoin.shingles(" ".join(words)))[:first]

    def edited(words, places):
        words = list(words)
        for _ in range(places):
            while True:
                other = list(words)
                other[rng.randrange(3, 297)] = f"{tag}y{rng.randrange(10**9)}"
                if np.array_equal(np.sort(ngramjoin.shingles(" ".join(other)))[:first], prefix) and sum(a != b for a, b in zip(words, other)):
                    break
            words = other
        return words

    b = edited(words, 8)
    return [" ".join(words), " ".join(b), " ".join(edited(b, 2))]


def test_jaccard_links_inside_a_group(spark, monkeypatch):
    rng = random.Random(4)
    texts = [t for k in range(6) for t in revisions(rng, f"t{k}_")]
    n, comp = brute_jaccard(texts)
    assert comp == [x for k in range(0, 18, 3) for x in (k, k + 1, k + 1)]
    monkeypatch.setattr(ngramjoin, "frequency_rank", lambda *a: np.zeros(2, np.uint8))  # one counter's worth of order: by hash alone
    got = {r.doc_id: r for r in ngramjoin.jaccard_components(docs(spark, texts)).collect()}
    assert [got[i].n_shingles for i in range(18)] == n
    assert [got[i].component_id for i in range(18)] == comp


def test_counters_are_narrow(spark):
    """Counters take the fewest bytes that hold them, and the ranks are those of the counts."""
    for top, width in ((0, 1), (255, 1), (256, 2), (65536, 4), (2**32, 8)):
        counts = np.array([0, 1, top, 0], np.int64)
        held = ngramjoin.narrow(counts)
        assert len(held) == 4 * width and ngramjoin.widened(held, 4).tolist() == counts.tolist()
    given = [f"common words here {i % 7} then {i}" for i in range(600)]
    want = np.zeros(1 << 16, np.int64)
    for x in given:
        np.add.at(want, ngramjoin._buckets(ngramjoin.shingles(x), 16), 1)
    for parts in (3, 300):  # in one step and in two
        got = ngramjoin.frequency_rank(docs(spark, given).repartition(parts), "doc_id", "text", 3, 16)
        assert got.tolist() == np.minimum(255, 4 * np.log2(1 + want)).astype(np.uint8).tolist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


# 6
def test_quality_learns_held_out(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["and", "the", "stone", "river,", "walks."]) for _ in range(rng.randint(20, 90))) for _ in range(300)]
    bad = [" ".join(w + rng.choice(["%%%", "###", "***"]) for w in t.split()) for t in good[:150]]
    texts = good + bad + [None, ""]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(450)], "doc_id bigint, quality int, toxic int")
    model = quality.train(d, labels)
    got = {r.doc_id: r for r in quality.score_quality(d, model).collect()}
    assert model.rules and len(got) == 452
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7)
    held = [i for i in range(450) if got[i].held_out]
    assert np.mean([got[i].predicted == int(i < 300) for i in held]) > 0.97
    assert quality.train(d, labels.limit(0)).rules == ()
    x = np.array([quality.statistics(t) for t in texts])
    np.testing.assert_allclose(model.scores(x), [got[i].score for i in range(452)], atol=1e-9)
    assert quality.keep_good(d, model, ["doc_id", "text", "lang", "source", "n_chars"]).count() == sum(r.predicted for r in got.values())


# 7
def test_warc_round_trip(spark):
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "é" * 3000, "<p>a</p>"]
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\n", h) for i, h in enumerate(html)] + [(None, None, "<p>b</p>")], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in warc.archive_round_trip(pages).collect()}
    assert [(got[i].record_type, got[i].refers_to) for i in range(7)] == [("revisit", 6), ("response", None), ("revisit", 6), ("revisit", 4), ("response", None), ("response", None), ("response", None)]
    assert all(got[i].payload_digest == warc.digest((h or "").encode()) and got[i].payload_bytes == len((h or "").encode()) for i, h in enumerate(html))
    assert got[None].record_type == "response" and warc.archive_round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    recs = [warc.record(i, f"http://x/{i}", (f"<p>{i}</p>" * 50).encode(), None) for i in range(8)]
    parts = [warc.member(r) if zipped else r for r in recs]
    data = bytearray(b"".join(parts))
    start = [sum(map(len, parts[:i])) for i in range(9)]
    data[start[2] + len(parts[2]) // 2] ^= 0xFF
    del data[start[6] + 40 : start[6] + 60]
    out = list(warc.salvage(b"junk" + bytes(data) + b"\x1f\x8b\x08tail"))
    assert [x["page_id"] for x in out if "gap" not in x] == [0, 1, 3, 4, 5, 7]
    assert sum(x["length"] for x in out) == len(data) + 4 + 7 and len([x for x in out if "gap" in x]) == 4
    at = 0
    for x in out:
        assert x["offset"] == at
        at += x["length"]


def test_damaged_files_are_quarantined(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 40) for i in range(30)], "page_id bigint, url string, html string")
    folder = f"file://{tmp_path}/w"
    manifest = warc.cut(warc.write_archives(warc.with_revisits(pages.coalesce(1)), folder), "manifest")
    assert warc.reconciled(manifest, warc.read_archives(manifest, folder)).count() == 0
    path = manifest.first().path
    data = bytearray(open(path, "rb").read())
    hit = warc.read_archives(manifest, folder).where("page_id = 15").first()
    data[hit.offset + hit.length // 2] ^= 0xFF
    open(path, "wb").write(bytes(data))
    found = warc.read_archives(manifest, folder, keep_payload=True)
    assert found.where("gap is null and payload is not null").count() == 29
    assert [(r.records, r.read, r.gaps) for r in warc.reconciled(manifest, found).collect()] == [(30, 29, 1)]
    gap = warc.quarantine(found).collect()
    assert len(gap) == 1 and gap[0].path == path and gap[0].length > 0 and gap[0].reason
    real = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda *a: real(*a).where("page_id <> 3"))
    with pytest.raises(RuntimeError, match="manifest"):
        warc.archive_round_trip(pages)


def test_clashing_page_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>", 9, "x", 3), (1, "u", "<p>", 8, "y", 4), (2, "v", "<p>", 7, "z", 5)], "page_id bigint, url string, html string, PAGE_ID int, sha string, refers_to int")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect())
    assert got == [(1, "revisit", 2), (1, "revisit", 2), (2, "response", None)]


def test_members_are_bounded(monkeypatch):
    monkeypatch.setattr(warc, "MAX_MEMBER", 1000)
    data = warc.member(warc.record(1, "u", b"x" * 100, None)) + warc.member(warc.record(2, "u", b"x" * 2000, None)) + warc.member(warc.record(3, "u", b"", None))
    out = list(warc.salvage(data))
    assert [x.get("page_id", x.get("gap")) for x in out] == [1, "member size", 3]


# 8
def test_bpe_equals_the_library(spark, corpus):
    tok = Tokenizer.from_file(VOCAB)
    rng = random.Random(4)
    texts = corpus + ["".join(rng.choice("abcdeéèßñΣσ 's.\n!1²<|") for _ in range(200)) for _ in range(100)]
    got = {r.doc_id: r for r in bpe.encode_digests(docs(spark, texts), VOCAB).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    plain = bpe.encode_texts(docs(spark, texts[:5]), VOCAB).orderBy("doc_id").collect()
    assert [r.ids for r in plain] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts[:5]]


# 9
def test_shards_fit(spark, corpus):
    rows = sharding.document_shards(docs(spark, corpus), limit=4000).collect()
    size = {}
    for r in rows:
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
        h = f"{int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16):060b}"
        assert h.startswith(r.shard) and len(r.shard) == r.depth and r.n_bytes == len((corpus[r.doc_id] or "").encode())
    assert len(rows) == len(corpus)
    for r in rows:
        assert r.shard_bytes == size[r.shard] and r.oversize == (r.shard_bytes > 4000) and (not r.oversize or r.shard_rows == 1)
    names = set(size)
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    same = sharding.document_shards(docs(spark, ["x" * 3000] * 5, [None, None, 1, 1, 2]), limit=4000).collect()
    assert len(same) == 5 and sum(r.oversize for r in same) == 4
    assert sharding.document_shards(docs(spark, [])).count() == 0


def test_shards_at_many_depths(spark):
    d = docs(spark, ["x" * 10] * 400 + ["y" * 300] * 30, [*range(400), *[7] * 30])
    rows = sharding.document_shards(d, limit=40).collect()
    assert len(rows) == 430
    size = {}
    for r in rows:
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
        assert f"{int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16):060b}".startswith(r.shard)
    assert all(r.shard_bytes == size[r.shard] and r.oversize == (r.shard_bytes > 40) == (r.doc_id == 7) for r in rows)


def test_written_shards_keep_every_row(spark, tmp_path):
    d = pick(docs(spark, ["x" * 3000, "y" * 3000, None, "z"], [None, 1, None, 1]), "doc_id", "text", "lang")
    sharding.write_shards(d, str(tmp_path / "out"), "doc_id", F.octet_length("text"), limit=4000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id or -1, len(r.text or "")) for r in back.collect()) == [(-1, 0), (-1, 3000), (1, 1), (1, 3000)]
    assert set(d.columns) < set(back.columns)


# 10
def test_media_round_trip(spark, corpus):
    got = {r.doc_id: r for r in mpeg.media_columns(docs(spark, corpus)).collect()}
    for i, t in enumerate(corpus):
        n, payload = mpeg.padded(t)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
    read = {r.doc_id: r for r in mpeg.read_streams(mpeg.media_columns(docs(spark, corpus))).collect()}
    assert all(r.bad_crc == 0 and r.skipped == 0 and r.frames == len(r.offsets) and r.duration_us == r.frames * 24000 for r in read.values())


def test_media_resynchronises():
    payload = bytes(range(32, 127)) * 60
    data = mpeg.encode(payload)
    d = mpeg.decode(data)
    cut = d["offsets"][2]
    broken = mpeg.decode(data[:cut] + b"\xff\xfbnoise" + data[cut:])
    assert broken["skipped"] == 7 and broken["payload"] == payload and len(broken["offsets"]) == len(d["offsets"])
    flipped = bytearray(data)
    flipped[cut + 10] ^= 1
    assert mpeg.decode(bytes(flipped))["bad_crc"] == 1


def test_media_that_looks_like_a_tag():
    for n in (200, 300, 1000, 5000):
        for at in range(n - 128, n - 2):
            payload = b"x" * at + b"TAG" + b"y" * (n - at - 3)
            d = mpeg.decode(mpeg.encode(payload))
            assert d["payload"] == payload and not d["skipped"] and not d["bad_crc"]
    data = mpeg.encode(b"abc" * 500)
    d = mpeg.decode(data)
    tag = b"TAG\xff" + bytes(124)
    for junk in (b"", b"\xffjunk"):
        tagged = mpeg.decode(data + junk + tag)
        assert tagged["payload"] == d["payload"] and tagged["offsets"] == d["offsets"] and tagged["skipped"] == len(junk)


def hand_made(version, layer, mono, index, fs, protected, rng):
    """A frame by the standard's formulas, put together bit by bit; Layers I and II have a random allocation."""
    b1 = 0xE0 | {1: 3, 2: 2, 2.5: 0}[version] << 3 | (4 - layer) << 1 | (not protected)
    head = bytes([0xFF, b1, index << 4 | fs << 2, 0xC0 if mono else 0x00])
    rate = [44100, 48000, 32000][fs] // {1: 1, 2: 2, 2.5: 4}[version]
    kbps = {(1, 1): 32 * index, (1, 2): [32, 48, 56, 64, 80, 96, 112, 128][index - 1], (1, 3): [32, 40, 48, 56, 64, 80, 96, 112][index - 1], (2, 1): [32, 48, 56, 64, 80, 96, 112, 128][index - 1]}.get((int(version), layer), 8 * index)
    samples = {1: 384, 2: 1152, 3: 1152 if version == 1 else 576}[layer]
    size = 4 * (12 * kbps * 1000 // rate) if layer == 1 else samples // 8 * kbps * 1000 // rate
    body = bytearray(rng.randrange(254) for _ in range(size - 4 - 2 * protected))
    if protected:
        side = {(1, False): 32, (1, True): 17, (2, False): 17, (2, True): 9}[min(int(version), 2), mono]
        if layer == 3:
            covered = "".join(f"{x:08b}" for x in body[:side])
        elif layer == 1:
            covered = "".join(f"{x:08b}" for x in body)[: 128 if mono else 256]
        else:
            bits, at, used = "".join(f"{x:08b}" for x in body), 0, 0
            per = kbps // (1 if mono else 2)
            widths = [4] * 4 + [3] * 7 + [2] * 19 if version > 1 else [4] * 2 + [3] * (10 if rate == 32000 else 6) if per < 56 else [4] * 11 + [3] * 12 + [2] * (7 if per > 80 and rate != 48000 else 4)
            for w in widths:
                for _ in range(1 if mono else 2):
                    used += int(bits[at : at + w], 2) > 0
                    at += w
            covered = bits[: at + 2 * used]
        crc = 0xFFFF
        for bit in "".join(f"{x:08b}" for x in head[2:]) + covered:
            top = crc >> 15
            crc = crc << 1 & 0xFFFF
            if top != int(bit):
                crc ^= 0x8005
        body = crc.to_bytes(2, "big") + body
    return head + bytes(body), samples, rate


@pytest.mark.parametrize("version", [1, 2, 2.5])
@pytest.mark.parametrize("layer", [1, 2, 3])
@pytest.mark.parametrize("mono", [False, True])
def test_frames_that_the_writer_does_not_make(version, layer, mono):
    rng = random.Random(f"{version}{layer}{mono}")
    for protected, index, fs in itertools.product((True, False), (4, 8), (0, 1, 2)):
        frames = [hand_made(version, layer, mono, index, fs, protected, rng) for _ in range(5)]
        data = b"".join(f[0] for f in frames)
        d = mpeg.decode(data)
        assert d["offsets"] == [i * len(frames[0][0]) for i in range(5)] and not d["bad_crc"] and not d["skipped"]
        assert mpeg.duration_us(d) == 5 * frames[0][1] * 1_000_000 // frames[0][2]
        if protected:
            bad = bytearray(data)
            bad[2 * len(frames[0][0]) + 7] ^= 0x80
            assert mpeg.decode(bytes(bad))["bad_crc"] == 1
        noisy = mpeg.decode(b"junk" + data[: 2 * len(frames[0][0])] + b"\x00" * 9 + data[2 * len(frames[0][0]) :])
        assert noisy["skipped"] >= 13 and len(noisy["offsets"]) >= 3 + protected


def test_tags_and_tables_that_the_writer_does_not_make():
    rng = random.Random(8)
    frame = hand_made(1, 3, False, 8, 0, False, rng)[0]
    text = lambda enc, s: bytes([enc]) + s.encode(["latin-1", "utf-16", "utf-16-be", "utf-8"][enc])
    synchsafe = lambda n: bytes(n >> s & 127 for s in (21, 14, 7, 0))
    title = text(1, "Übung " * 40)
    v23 = b"TIT2" + len(title).to_bytes(4, "big") + b"\0\0" + title
    tag = b"ID3\x03\0\0" + synchsafe(len(v23) + 20) + v23 + bytes(20)
    v22 = b"TXX" + (8).to_bytes(3, "big") + b"\x00ab\x00cde\x00"[:8]
    old = b"ID3\x02\0\0" + synchsafe(len(v22)) + v22
    wide = (b"TPE1" + (4).to_bytes(4, "big") + b"\0\0" + b"\x00a\xffb").replace(b"\xff", b"\xff\x00")
    unsync = b"ID3\x03\0\x80" + synchsafe(len(wide)) + wide
    xing = bytearray(frame)
    xing[36:48] = b"Info" + (2).to_bytes(4, "big") + (77).to_bytes(4, "big")
    d = mpeg.decode(tag + old + unsync + bytes(xing) + frame * 3)
    assert d["tags"] == {"TIT2": "Übung " * 40, "ab": "cde", "TPE1": "aÿb"} and len(d["offsets"]) == 3
    assert (d["vbr"]["kind"], d["vbr"]["frames"], d["vbr"]["bytes"], d["vbr"]["toc"]) == ("Info", None, 77, None)
    vbri = bytearray(frame)
    vbri[36:66] = b"VBRI" + bytes(6) + (5000).to_bytes(4, "big") + (9).to_bytes(4, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + (2).to_bytes(2, "big") + (4).to_bytes(2, "big") + b"\x01\x02\x03\x04"
    got = mpeg.decode(bytes(vbri) + frame * 3)["vbr"]
    assert (got["kind"], got["frames"], got["bytes"], got["toc"]) == ("VBRI", 9, 5000, b"\x01\x02\x03\x04")
    assert mpeg.decode(b"")["offsets"] == [] and mpeg.duration_us(mpeg.decode(b"")) == 0


def test_nothing_but_named_columns(spark):
    d = docs(spark, ["a"])
    assert pick(d, "text").columns == ["text"] and pick(d, "text").first()[0] == "a"
    assert d.select(F.lit(1)).count() == 1


def scan(d):
    return licenses.scan_licenses(d).drop("spans")


def spans(d):
    return pii.pii_spans(d)


def scored(d):
    return quality.score_quality(d, quality.RuleModel(0.3, ((((0, True, 2.0),), -1.5),)))


def encoded(d):
    return bpe.encode_digests(d, VOCAB)


def dealt(d):
    return sharding.document_shards(d).drop("shard", "depth", "shard_bytes", "shard_rows", "oversize")


@pytest.mark.parametrize("operator", [scan, spans, scored, encoded, dealt, mpeg.media_digests], ids=lambda f: f.__name__)
def test_nulls_repeats_and_empty_tables(spark, operator):
    """Rows with null and repeated keys and texts are each answered, as the same text under a key of its own is; clashing columns do no harm."""
    texts = ["mit license a@b.cc", None, "", "mit license a@b.cc", "x y z", None, "\x00 é 😀"]
    got = operator(docs(spark, texts, [1, None, None, 1, 2, 3, None]))
    plain = operator(pick(docs(spark, texts, list(range(10, 17))), "doc_id", "text"))
    value = lambda r, skip: repr([(k, v) for k, v in r.asDict().items() if k not in skip])
    skip = {"doc_id", "held_out"}
    assert sorted(value(r, skip) for r in got.collect()) == sorted(value(r, skip) for r in plain.collect())
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(["1", "1", "2", "3", "None", "None", "None"])
    none = operator(docs(spark, []))
    assert none.count() == 0 and none.columns == got.columns


def test_packing_of_nulls_and_repeats(spark):
    texts, ids = ["mit license a@b.cc", None, "", "mit license a@b.cc", "x y z", None], [1, None, None, 1, 2, 3]
    tok = Tokenizer.from_file(VOCAB)
    out = packing.pack(docs(spark, texts, ids), VOCAB).collect()
    want = {}
    for i, t in zip(ids, texts):
        want[i] = want.get(i, 0) + len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    fill = {}
    for r in out:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sorted(p)[0][0] == 0 and sum(n for _, n in p) == max(a + n for a, n in p) for p in fill.values())
    assert packing.pack(docs(spark, []), VOCAB).count() == 0


def test_repeated_and_null_vector_keys(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, v), (1, v), (1, w), (2, w), (None, v), (3, None), (3, v)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert len(got) == 7 and all(r.component_id == 1 for r in got if r.vec_id in (1, 2)) and all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id)


def test_passes_alone_keep_their_recall(spark):
    """Isolated pairs at a cosine just above the threshold, found without the comparison of all rows."""
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((6000, 64)))
    a, noise = x[:300], rng.standard_normal((300, 64))
    b = unit(0.955 * a + np.sqrt(1 - 0.955**2) * unit(noise - (noise * a).sum(1, keepdims=True) * a))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, b]))]
    got = {r.vec_id: r.component_id for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), exhaustive=False).collect()}
    assert np.mean([got[6000 + i] == i for i in range(300)]) >= 0.99
    assert [vectors.passes_for(n) for n in (10, 10_000, 10**6, 10**9)] == [1, 13, 31, 95]


def test_without_labels_nothing_is_rejected(spark):
    d = docs(spark, ["a b c", None, "###"])
    model = quality.train(d, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert quality.keep_good(d, model, ["doc_id", "text"]).count() == 3


def test_pipeline_stages(spark, tmp_path, corpus):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = str(tmp_path)
    texts = [t for t in corpus if t and len(t) < 4000] + ["mail me a.b@c.de today " * 3]
    plain = pick(docs(spark, texts), "doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    kept = pipeline.dedup_stage(spark, plain, sf).collect()
    n, comp = brute_jaccard(texts)
    assert sorted(r.doc_id for r in kept) == [i for i in range(len(texts)) if comp[i] == i]
    pieces = pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in kept}
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "ngram_join", "pii", "packing"]


def test_pipeline_with_labels_nulls_and_repeats(spark, tmp_path):
    """Each stage against what it should keep: the quality stage decides, copies go, personal data goes, and every kept row is packed."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    sf = str(tmp_path)
    good = [" ".join(rng.choice(["and", "the", "stone", "river,", "walks."]) + rng.choice(["", "s"]) for _ in range(rng.randint(30, 90))) for _ in range(200)]
    bad = [" ".join(w + rng.choice(["%%%", "###", "***"]) for w in t.split()) for t in good[:100]]
    odd = [None, "", good[0], good[0], "mail a.b@c.de and +1 555 123 4567 " + good[1], "the river walks. " * 20000]
    ids = [*range(300), 300, None, None, 301, 302, 303]
    rows = list(zip(ids, [*good, *bad, *odd]))
    d = pick(docs(spark, [t for _, t in rows], [i for i, _ in rows]), "doc_id", "text", "lang", "source", "n_chars").withColumns({c: F.lit(1) for c in ("extra", "_text", "score", "log_bytes", "_c0", "id")})
    d.write.parquet(f"{sf}/documents.parquet")
    labels = [(i, int(i < 200), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0), (7, 1, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    first = pipeline.quality_stage(spark, d, sf)
    assert first.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    model = quality.train(d, spark.read.parquet(f"{sf}/labels.parquet"))
    want = [(i, t) for i, t in rows if model.scores(np.array([quality.statistics(t)]))[0] >= 0.7]
    kept = [(r.doc_id, r.text) for r in first.collect()]
    assert sorted(map(repr, kept)) == sorted(map(repr, want)) and 150 < len(kept) < 260
    second = pipeline.dedup_stage(spark, first, sf)
    left = [(r.doc_id, r.text) for r in second.collect()]
    known = [t for i, t in left if i is not None and t]
    assert len(known) == len(set(known)) and set(known) <= {t for _, t in kept} and [t for i, t in left if i is None] == [t for i, t in kept if i is None]
    third = {(r.doc_id, r.text) for r in pipeline.pii_stage(spark, second, sf).collect()}
    assert len(third) == len(set(left)) and not any("@" in (t or "") or "+1 555" in (t or "") for _, t in third)
    end = pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in end} == {i for i, _ in left}
    assert all(r.length > 0 for r in end)


def test_pipeline_of_empty_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = str(tmp_path)
    pick(docs(spark, []), "doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert pipeline.run(spark, sf).count() == 0
