"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

Every prefix of a word has one last token. A token that ends a prefix is that one exactly if it is compatible with the last token of what
stands before it: merging the two tokens' characters yields the same two tokens again. The tokens that end at a place come from a suffix
automaton over the whole vocabulary, so a word costs time in proportion to its length; following the last tokens back gives its ids.

Texts are cut into pre-tokens, which no token spans; what each of them encodes to is kept in a bounded table of the worker.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tidemark.llm.automaton import SuffixAutomaton
from tidemark.llm.common import map_texts

#: Words kept by a worker before they age (the old ones are kept until as many new ones are), and the longest that are kept.
CACHE_WORDS, CACHE_LETTERS = 250_000, 32
#: The vocabulary's pre-tokens, its markers and the mark of a word's end.
ASCII_WORDS = re.compile(r"[a-z]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\sa-z0-9]+", re.ASCII)
MARKERS = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
END = "</w>"
#: Below this character, text is in composed form already and its classes are stable.
LATIN = "ɐ"
_BEYOND = re.compile(f"[{LATIN}-\U0010ffff]")


def _latin_words() -> re.Pattern:
    """The pre-tokens of text below LATIN in lower case: runs of letters, single digits, runs of anything else but white space."""
    chars = {c for i in range(ord(LATIN)) for c in chr(i) + chr(i).lower()}
    of = lambda kind: "".join(sorted(re.escape(c) for c in chars if unicodedata.category(c)[0] == kind))
    return re.compile(f"[{of('L')}]+|'s|'t|'re|'ve|'m|'ll|'d|[{of('N')}]|[^\t-\r \x85\xa0{of('L')}{of('N')}]+")


LATIN_WORDS = _latin_words()


def plain_words(text: str) -> list[str] | None:
    """The pre-tokens of a text below LATIN without markers, in lower case; None for any other text."""
    if "<|" in text:
        return None
    if text.isascii():
        return ASCII_WORDS.findall(text.lower())
    return None if _BEYOND.search(text) else LATIN_WORDS.findall(text.lower())


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(spare)) for b in range(256)}


class PrefixBpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        self.letter = [letters[b] for b in range(256)]
        self.ids, self.symbols = vocab, {i: self.split(t) for t, i in vocab.items()}
        self.markers = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.markers.items()}
        self.rank = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault((a, b), r)
        self.machine = SuffixAutomaton()
        numbers: dict[str, int] = {}
        self.number = numbers
        coded = {i: [numbers.setdefault(s, len(numbers)) for s in seq] for i, seq in self.symbols.items()}
        for i in sorted(coded, key=lambda i: len(coded[i])):
            self.machine.add(coded[i])
        m = self.machine
        own: list = [()] * len(m.length)
        for i, seq in coded.items():
            v = m.find(seq)
            own[v] = (*own[v], (len(seq), i))
        for v in sorted(range(1, len(m.length)), key=m.length.__getitem__):
            longer = sorted(own[v], reverse=True)
            own[v] = (*longer, *own[m.link[v]]) if longer else own[m.link[v]]
        #: for each state, the tokens that end its strings, longest first
        self.ending = own
        #: compatible pairs and others, by first id * 2**20 + second id
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        #: what words encode to: ids, ids in decimal, and the decoded text
        self.words: dict[str, tuple[tuple[int, ...], bytes, bytes]] = {}
        self.old: dict[str, tuple[tuple[int, ...], bytes, bytes]] = {}

    @staticmethod
    def split(token: str) -> list[str]:
        """A token's letters; the last one bears the mark of the word's end if the token does."""
        if token.endswith(END) and len(token) > len(END):
            body = token[: -len(END)]
            return [*body[:-1], body[-1] + END]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """What merging by rank makes of a few letters: the definition that compatibility is tested against."""
        parts, rank = list(symbols), self.rank
        while len(parts) > 1:
            best = min((rank.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 30:
                break
            a, b = parts[best[1]], parts[best[1] + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def compatible(self, a: int, b: int) -> bool:
        ok = self.fits.get(a << 20 | b)
        if ok is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            ok = self.fits[a << 20 | b] = self.merged(self.symbols[a] + self.symbols[b]) == [self.token[a], self.token[b]]
        return ok

    def reachable(self, t: int) -> bool:
        ok = self.whole.get(t)
        if ok is None:
            ok = self.whole[t] = self.merged(self.symbols[t]) == [self.token[t]]
        return ok

    def encode_word(self, word: str) -> tuple[int, ...]:
        """ids of one pre-token, given in byte letters, by the last token of each of its prefixes."""
        step, link, length, ending = self.machine.step, self.machine.link, self.machine.length, self.ending
        fits, number = self.fits, self.number
        n = len(word)
        symbols = [number[c] for c in word]
        symbols[-1] = number[word[-1] + END]
        last, size = [-1], [0]
        state = run = i = 0
        for c in symbols:
            i += 1
            to = step[state].get(c)
            while to is None:
                state = link[state]
                run = length[state]
                to = step[state].get(c)
            run += 1
            state = to
            for k, t in ending[to]:
                if k < i:
                    if k > run:
                        continue
                    p = last[i - k]
                    ok = fits.get(p << 20 | t)
                    if ok is None:
                        ok = self.compatible(p, t)
                elif k == i:
                    ok = run >= k and self.reachable(t)
                else:
                    continue
                if ok:
                    last.append(t)
                    size.append(k)
                    break
        out, i = [], n
        while i > 0:
            out.append(last[i])
            i -= size[i]
        return tuple(reversed(out))

    def lettered(self, word: str) -> str:
        """A word in byte letters."""
        return word if word.isascii() and word.isalpha() else "".join([self.letter[b] for b in word.encode()])

    def of_word(self, word: str) -> tuple[tuple[int, ...], bytes, bytes]:
        """What a pre-token in lower case encodes to, kept for the next time."""
        got = self.old.get(word)
        if got is None:
            ids = self.encode_word(self.lettered(word))
            got = ids, " ".join(map(str, ids)).encode(), self.decode(ids).encode()
        if len(word) <= CACHE_LETTERS:
            if len(self.words) >= CACHE_WORDS:
                self.old, self.words = self.words, {}
            self.words[word] = got
        return got

    def parts(self, text: str) -> list[tuple[tuple[int, ...], bytes, bytes]]:
        """What the pre-tokens of a text encode to, in order."""
        words = plain_words(text)
        if words is not None:
            got = list(map(self.words.get, words))
            return [self.words.get(w) or self.of_word(w) if x is None else x for w, x in zip(words, got)] if None in got else got
        out = []
        for piece in text.encode().split():  # no token spans ASCII white space
            p = piece.decode()
            words = plain_words(p)
            if words is not None:
                out += [self.words.get(w) or self.of_word(w) for w in words]
                continue
            for part in MARKERS.split(p):
                if part in self.markers:
                    i = self.markers[part]
                    out.append(((i,), b"%d" % i, part.encode()))
                elif part:
                    for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                        ids = self.encode_word(w)
                        out.append((ids, " ".join(map(str, ids)).encode(), self.decode(ids).encode()))
        return out

    def encode(self, text: str | None) -> list[int]:
        return [i for x in self.parts(text or "") for i in x[0]]

    def decode(self, ids: Sequence[int]) -> str:
        """As the library does for a vocabulary without a decoder: tokens joined by spaces, unknown ids left out."""
        return " ".join([self.token[i] for i in ids if i in self.token])

    def written(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal, SHA-256 of the decoded text."""
        got = self.parts(text or "")
        ids = b" ".join([x[1] for x in got])
        back = b" ".join([x[2] for x in got])
        return ids.count(b" ") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()


@lru_cache(maxsize=2)
def coder(path: str) -> PrefixBpe:
    return PrefixBpe(path)


FIELDS = [("n_tokens", "bigint", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]


def encode_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Count and digests of the ids and of the decoded text of every row; `path` is the vocabulary file on each machine.

    Null and empty texts have no ids and the digests of nothing; null and repeated keys stay rows of their own; an empty table gives no
    rows.
    """

    def run(texts: list) -> list[list]:
        c = coder(path)
        rows = [c.written(t) for t in texts]
        return [list(x) for x in zip(*rows)] if rows else [[], [], []]

    return map_texts(docs, key, text, FIELDS, run)


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ids themselves, and the decoded text."""
    fields = [("ids", "array<int>", pa.list_(pa.int32())), ("decoded", "string", pa.string())]

    def run(texts: list) -> list[list]:
        c = coder(path)
        ids = [c.encode(t) for t in texts]
        return [ids, [c.decode(i) for i in ids]]

    return map_texts(docs, key, text, fields, run)
