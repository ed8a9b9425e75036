"""Licence scan: matching statistics of whole texts against a generalised suffix automaton of licence words.

Words are looked up in the automaton one after another; it keeps the longest run of words, ending here, that stands in some template.
Runs of MIN_RUN words or more that cannot grow to the right are chained, template by template, into covered spans. Short phrases are
templates of the same automaton, and count wherever their state lies on the suffix links of the current one.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.automaton import SuffixAutomaton
from tidemark.llm.common import map_texts

#: Phrases of the contract and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Whole texts of public licences that are short, and the standard notices of long ones, by label.
TEMPLATES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
        OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mit-notice": "Released under the MIT License.",
    "mit-short-notice": "is licensed under the terms of the MIT license",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law
        or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
        under the License.""",
    "gpl-3.0-notice": "licensed under the GNU General Public License, version 3",
    "gpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program
        is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
        or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the
        GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "lgpl-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
        This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "agpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
        program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
        CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
        LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
        AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
        WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause-endorsement": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.""",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
        AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
        EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
        FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
        any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
        software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
        product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must
        be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or
        altered from any source distribution.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means.""",
    "boost-1.0-text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit
        the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do
        so, all subject to the following:""",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
}
MIN_RUN, MAX_GAP, MIN_COVER, PHRASE_SCORE = 4, 40, 0.6, 0.75

_WORD = set(range(48, 58)) | set(range(97, 123)) | set(range(128, 256))
_BLANKED = bytes(c if c in _WORD else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of ASCII letters, digits and all characters beyond ASCII."""
    return (text or "").encode().translate(_BLANKED).split()


class LicenseScanner:
    def __init__(self, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, min_run: int = MIN_RUN, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER) -> None:
        phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
        self.min_run, self.max_gap, self.min_cover = min_run, max_gap, min_cover
        self.phrase_labels, self.names = list(phrases.values()), list(templates)
        phrase_words, self.texts = [words(p) for p in phrases], [words(t) for t in templates.values()]
        self.ids: dict[bytes, int] = {}
        for seq in (*phrase_words, *self.texts):
            for w in seq:
                self.ids.setdefault(w, len(self.ids) + 1)
        coded = [[self.ids[w] for w in s] for s in self.texts]
        self.machine = m = SuffixAutomaton()
        for seq in ([self.ids[w] for w in s] for s in phrase_words):
            m.add(seq)
        for seq in coded:
            m.add(seq)
        order = sorted(range(1, len(m.length)), key=m.length.__getitem__)
        own: list[list[tuple[int, int]]] = [[] for _ in m.length]
        for k, s in enumerate(phrase_words):
            if s:
                own[m.find(self.ids[w] for w in s)].append((len(s), k))
        self.phrases_at = own
        for v in order:  # links lead to shorter states, so parents are complete
            own[v] = own[v] + own[m.link[v]]
        #: for each state, the places in templates where its strings end
        self.ends: list[list[tuple[int, int]]] = [[] for _ in m.length]
        for k, seq in enumerate(coded):
            for i, v in enumerate(m.prefixes(seq)):
                while v > 0 and m.length[v] >= min_run:
                    self.ends[v].append((k, i + 1))
                    v = m.link[v]

    def scan(self, text: str | None) -> dict:
        step, link, length = self.machine.step, self.machine.link, self.machine.length
        phrases_at, min_run = self.phrases_at, self.min_run
        found = words(text)
        n_base, first, last, base, runs = 0, None, None, set(), []
        state = run = 0
        get = self.ids.get
        for i, c in enumerate([get(w, 0) for w in found]):
            if not c:
                if run >= min_run:
                    runs.append((i, run, state))
                state = run = 0
                continue
            to = step[state].get(c)
            if to is None:
                if run >= min_run:
                    runs.append((i, run, state))
                while to is None and state > 0:
                    state = link[state]
                    to = step[state].get(c)
                run, state = (length[state] + 1, to) if to is not None else (0, 0)
            else:
                run, state = run + 1, to
            if run > 1 and phrases_at[state]:
                for n, k in phrases_at[state]:
                    if n <= run:
                        at = i + 1 - n
                        n_base += 1
                        base.add(self.phrase_labels[k])
                        first = at if first is None or at < first else first
                        last = at if last is None or at > last else last
        if run >= min_run:
            runs.append((len(found), run, state))
        spans = self.chain(runs) if runs else []
        good = [s for s in spans if s["cover"] >= self.min_cover]
        score = max([s["cover"] for s in spans] + [PHRASE_SCORE] * bool(base), default=0.0)
        return {"n_words": len(found), "n_base": n_base, "first_word": first, "last_word": last, "base_labels": sorted(base), "labels": sorted(base | {s["label"] for s in good}), "score": score, "spans": good}

    def chain(self, runs: list[tuple[int, int, int]]) -> list[dict]:
        """Runs (end in the text, length, state) in the order of the text, joined where they go on in the same template.

        Each place of a run in a template is a link; it extends the open link of that template that gives it the most words, however many
        are open. Of a template's chains those with most words are taken, as far as they don't overlap in the text.
        """
        made: dict[int, list[tuple[int, int, int, int]]] = {}  # by template: words, start, end in the text, end in the template
        open_: dict[int, list[tuple[int, int, int, int]]] = {}
        for end, n, state in runs:
            a, fresh = end - n, []
            for k, stop in self.ends[state]:
                b = stop - n  # its start in the template
                best = (n, a, end, stop)
                for words_, start, e, t in open_.get(k, ()):
                    over = max(0, e - a, t - b)
                    if over < n and e < end and t < stop and a + over - e <= self.max_gap and b + over - t <= self.max_gap:
                        best = max(best, (words_ + n - over, start, end, stop))
                fresh.append((k, best))
            for k, link in fresh:
                made.setdefault(k, []).append(link)
                open_[k] = [x for x in open_.get(k, ()) if x[2] >= a - self.max_gap] + [link]
        out = []
        for k, links in made.items():
            taken: list[tuple[int, int]] = []
            for words_, start, end, _ in sorted(links, key=lambda x: (-x[0], x[2] - x[1], x[1])):
                if all(end <= s or start >= e for s, e in taken):
                    taken.append((start, end))
                    out.append({"label": self.names[k], "start": start, "end": end, "cover": words_ / len(self.texts[k])})
        return sorted(out, key=lambda c: (c["start"], c["label"]))


@lru_cache(maxsize=1)
def scanner() -> LicenseScanner:
    return LicenseScanner()


SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())])
FIELDS = [
    ("n_words", "bigint", pa.int64()), ("n_base", "bigint", pa.int64()), ("first_word", "bigint", pa.int64()), ("last_word", "bigint", pa.int64()),
    ("base_labels", "array<string>", pa.list_(pa.string())), ("labels", "array<string>", pa.list_(pa.string())), ("score", "double", pa.float64()),
    ("spans", "array<struct<label:string,start:bigint,end:bigint,cover:double>>", pa.list_(SPAN)),
]


def _scan(texts: list) -> list[list]:
    found = [scanner().scan(t) for t in texts]
    return [[x[f[0]] for x in found] for f in FIELDS]


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score and the covered template spans, for every row.

    Null and empty texts have no words, no labels, null places and score 0. Null and repeated keys are kept as rows of their own; an
    empty table gives no rows; other columns are not looked at. The score is the largest share of a template's words that a chain
    covers, and at least PHRASE_SCORE where a phrase stands.
    """
    return map_texts(docs, key, text, FIELDS, _scan)
