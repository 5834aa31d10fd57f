"""License scans: fixed phrases, and spans of license templates found with a generalised suffix automaton."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palate.llm.common import map_texts

# Fixed values of the contract: phrase and label.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Names by which texts say what they are licensed under, as label and name.
NAMES = [
    ("mit", "MIT License"), ("apache-2", "Apache License, Version 2.0"), ("bsd-2", "BSD 2-Clause License"), ("bsd-3", "BSD 3-Clause License"),
    ("isc", "ISC License"), ("zlib", "zlib License"), ("mpl-2", "Mozilla Public License, version 2.0"),
    ("gpl-2", "GNU General Public License, version 2"), ("gpl-3", "GNU General Public License, version 3"),
    ("lgpl-3", "GNU Lesser General Public License, version 3"), ("agpl-3", "GNU Affero General Public License, version 3"),
    ("cc-by", "Creative Commons Attribution 4.0 International License"), ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "CC BY 4.0"), ("cc-by-sa", "CC BY-SA 4.0"), ("cc-by-nc", "CC BY-NC 4.0"),
]
_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
    "DAMAGE."
)
_GPL = (
    "{it} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either "
    "version {n} of the License, or (at your option) any later version. {it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details."
)
# Whole public license texts, and for the long ones the notices by which they are applied, as label and text.
TEXTS = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
            f"Software. {_NO_WARRANTY}"),
    ("bsd-2", _BSD_HEAD + _BSD_TAIL),
    ("bsd-3", f"{_BSD_HEAD}3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
              f"from this software without specific prior written permission. {_BSD_TAIL}"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
            "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
            "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
            "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
             "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
             "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
             "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
             "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
             "software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
                  "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("apache-2", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
                 "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                 'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
                 "implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
              "You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("gpl-2", _GPL.format(it="This program", kind="General Public License", n=2)), ("gpl-3", _GPL.format(it="This program", kind="General Public License", n=3)),
    ("lgpl-3", _GPL.format(it="This library", kind="Lesser General Public License", n=3)),
    ("agpl-3", _GPL.format(it="This program", kind="Affero General Public License", n=3)),
]


def short_forms(names: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """How texts name their license in passing, by rule."""
    article = lambda name: "" if name.startswith("CC ") else "a " if name.startswith("Creative") else "the "
    return [(label, f"{verb} under {article(name)}{name}") for label, name in names for verb in ("licensed", "released", "distributed", "available")]


TEMPLATES = tuple(TEXTS + short_forms(NAMES))

# Upper case becomes lower; every other character up to DEL that is no letter or digit becomes a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """All substrings of several token sequences; each state knows where in which sequence one of its strings ends.

    Sizes grow with the templates alone: at most two states for each of their tokens."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, set[int]]] = [{}]
        for n, sequence in enumerate(sequences):
            last = 0
            for place, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].setdefault(n, set()).add(place + 1)
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                for n, places in self.ends[state].items():
                    self.ends[self.link[state]].setdefault(n, set()).update(places)

    def _new(self, length: int, nexts: dict[int, int], link: int) -> int:
        self.next.append(nexts)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.link) - 1

    def _split(self, p: int, token: int) -> int:
        """The state that p leads to by token, with strings no longer than p's and the token."""
        q = self.next[p][token]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        state, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = state
            p = self.link[p]
        self.link[state] = self._split(p, token) if p >= 0 else 0
        return state

    def suffixes(self, least: int) -> list[list[tuple[int, int]]]:
        """For each state (template, state) pairs: each template in which a suffix of `least` tokens or more of its string stands, and the state of the longest."""
        out: list[list[tuple[int, int]]] = [[] for _ in self.link]
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            if self.length[state] >= least:
                own = self.ends[state]
                out[state] = [(n, state) for n in own] + [(n, at) for n, at in out[self.link[state]] if n not in own]
        return out

    def longest(self, tokens: list[int], least: int, suffixes: list[list[tuple[int, int]]]) -> list[tuple[int, int, int, int]]:
        """Matching statistics of the stream against each template, kept where a match can't go on: (end, length, template, state).

        A template within a longer one has its own matches: they are suffixes of the longer one's at their ends."""
        out, state, n = [], 0, 0
        before: dict[int, tuple[int, int]] = {}
        for i, token in enumerate([*tokens, -1], 1):
            to = self.next[state].get(token)
            while to is None and state:
                state = self.link[state]
                n = self.length[state]
                to = self.next[state].get(token)
            state, n = (0, 0) if to is None else (to, n + 1)
            now = {}
            if n >= least:
                for template, at in suffixes[state]:
                    size = n if at == state else self.length[at]
                    now[template] = (size, at)
            for template, (size, at) in before.items():
                if now.get(template, (0,))[0] != size + 1:
                    out.append((i - 1, size, template, at))
            before = now
        return out


@lru_cache(4)
def _compiled(templates: tuple[tuple[str, str], ...], least: int) -> tuple[dict[bytes, int], Automaton, list, list[int], list[str]]:
    sequences = [words_of(text) for _, text in templates]
    ids: dict[bytes, int] = {}
    coded = [[ids.setdefault(w, len(ids)) for w in s] for s in sequences]
    automaton = Automaton(coded)
    return ids, automaton, automaton.suffixes(least), [len(s) for s in sequences], [label for label, _ in templates]


def chain(matches: list[tuple[int, int, int, int]], gap: int) -> tuple[int, int, int]:
    """The best chain of (from, to, template from, template to), sorted: ever later in both, with gaps of `gap` tokens at most.

    Returns the template tokens covered, and the chain's first and last token in the text. A match looks back at all
    that end within the gap before it or later."""
    best: list[tuple[int, int]] = []  # covered, start
    top, near = (0, 0, 0), []
    for i, (a, b, ta, tb) in enumerate(matches):
        covered, start = tb - ta, a
        near = [j for j in near if a - matches[j][1] <= gap]
        for j in near:
            pa, pb, pta, ptb = matches[j]
            # an overlap in the text or the template is cut from the later match
            cut = max(0, pb - a, ptb - ta)
            if pa < a and pta < ta and cut < tb - ta and ta - ptb <= gap and best[j][0] + tb - ta - cut > covered:
                covered, start = best[j][0] + tb - ta - cut, best[j][1]
        best.append((covered, start))
        near.append(i)
        if covered > top[0]:
            top = (covered, start, b)
    return top


# What a part of a label is called in texts, where that isn't the part itself.
PART_NAMES = {"lgpl": {b"lesser"}, "agpl": {b"affero"}, "nc": {b"nc", b"noncommercial"}, "sa": {b"sa", b"sharealike"}}


def deciding(label: str) -> list[set[bytes]]:
    """Words of which a span must hold one each to have the label: its version or number of clauses, and what narrows it."""
    return [PART_NAMES.get(p, {p.encode()}) for p in label.split("-") if p in PART_NAMES or p.isdigit()]


def every_chain(matches: list[tuple[int, int, int, int]], gap: int, enough: float) -> list[tuple[int, int, int]]:
    """The best chain, and as long as a chain covers `enough` the best of the matches that lie apart from it."""
    out = []
    while matches:
        covered, a, b = chain(matches, gap)
        if out and covered < enough:
            break
        out.append((covered, a, b))
        if covered < enough:
            break
        matches = [m for m in matches if m[1] <= a or m[0] >= b]
    return out


def template_spans(
    words: list[bytes], templates: tuple = TEMPLATES, least: int = 3, gap: int = 12, share: float | None = None
) -> list[tuple[int, float, int, int]]:
    """(template, share covered, first word, end) for each template that has a match of `least` words in the text: its
    best place and, where a share is given, all others that are covered to it.

    A template that doesn't stand there whole and without gap gives way to one that covers more words of the same
    stretch, or as many and more of itself: near names of licenses differ in one word."""
    ids, automaton, suffixes, lengths, _ = _compiled(templates, least)
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    run: list[int] = []
    for i, code in enumerate([*map(ids.get, words), None]):
        if code is not None:
            run.append(code)
            continue
        if len(run) >= least:
            at = i - len(run)
            for end, n, template, state in automaton.longest(run, least, suffixes):
                for place in automaton.ends[state][template]:
                    found.setdefault(template, []).append((at + end - n, at + end, place - n, place))
        if run:
            run = []
    spans = [(t, *c) for t, matches in found.items() for c in every_chain(sorted(matches), gap, (2 if share is None else share) * lengths[t])]
    shares = [(t, c, c / lengths[t], a, b) for t, c, a, b in spans]
    better = lambda c, share, a, b: any((x, y) > (c, share) and f <= a and b <= e for _, x, y, f, e in shares)
    return sorted((t, share, a, b) for t, c, share, a, b in shares if share == 1 and b - a == c or not better(c, share, a, b))


def scan(text: str | None, share: float = 0.8, templates: tuple = TEMPLATES) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of one text."""
    words = words_of(text)
    places, base = [], set()
    if words:
        joined = b" " + b" ".join(words) + b" "
        for phrase, label in PHRASES.items():
            needle = b" " + phrase.encode() + b" "
            at, counted, before = joined.find(needle), 0, 0
            while at >= 0:
                before += joined.count(b" ", counted, at)
                counted = at
                places.append(before)
                base.add(label)
                at = joined.find(needle, at + 1)
    labels = [label for label, _ in templates]
    spans = template_spans(words, templates, share=share)
    spans = [(t, covered, a, b) for t, covered, a, b in spans if all(not some.isdisjoint(words[a:b]) for some in deciding(labels[t]))]
    every = base | {labels[t] for t, covered, _, _ in spans if covered >= share}
    score = max([1.0 if base else 0.0, *(min(1.0, covered) for _, covered, _, _ in spans)])
    merged: list[tuple[str, int, int]] = []
    for label, a, b in sorted((labels[t], a, b) for t, covered, a, b in spans if covered >= share):
        if merged and merged[-1][0] == label and a < merged[-1][2]:
            merged[-1] = (label, merged[-1][1], max(b, merged[-1][2]))
        else:
            merged.append((label, a, b))
    said = ",".join(f"{label}:{a}:{b}" for label, a, b in sorted(merged, key=lambda s: (s[1], s[0], s[2])))
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(every)), score, said)


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple = TEMPLATES) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for each row of docs.

    spans lists the places of the templates, (label, text) pairs, that are covered to four fifths at least and hold the
    words that decide their label, with first word and end; overlapping spans of one label are one, and ties between a
    template's chains go to the first. score is the largest share of a template that one chain of
    matches covers, 1 where a phrase stands. A null text is empty, with score 0; a null key stays; repeated rows give
    repeated results; other columns are not read. No shuffle."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    kept = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_texts(kept, schema, lambda c: [(k, *scan(t, templates=templates)) for k, t in zip(*c)])
