"""Licence recognition: normalised sentences become identifiers, their order is matched with rules."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and notices. `{}` is a hole for a few words (a name, a year, a
# product). Forms of one identifier mean the same.
SENTENCES: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.", "{} licensed under the Apache License, Version 2.0.",
        "{} licensed under the Apache License 2.0.", "{} released under the Apache License, Version 2.0.",
    ],
    "apache-use": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        '{} licenses this file to you under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ],
    "apache-copy": [
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    ],
    "apache-basis": [
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "bsd-use": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "bsd-source": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "bsd-binary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "bsd-name": [
        "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Neither the name of {} nor the names of {} contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "The name of {} may not be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "bsd-disclaimer": [
        'THIS SOFTWARE IS PROVIDED BY {} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ],
    "bsd-liability": [
        "IN NO EVENT SHALL {} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "{} licensed under CC BY 4.0.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.",
        "{} licensed under CC BY-NC 4.0.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.",
        "{} licensed under CC BY-SA 4.0.",
    ],
    "cc0": ["To the extent possible under law, {} has waived all copyright and related or neighboring rights to this work."],
    "agpl3+": [
        "{} is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "gpl2": [
        "{} is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
        "{} is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ],
    "gpl2+": [
        "{} is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "gpl3": ["This work is licensed under the GNU General Public License, version 3.", "{} licensed under the GNU General Public License, version 3."],
    "gpl3+": [
        "{} is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "lgpl2.1+": [
        "{} is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "lgpl3+": [
        "{} is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "gnu-hope": [
        "{} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ],
    "gnu-see": [
        "See the GNU General Public License for more details.", "See the GNU Lesser General Public License for more details.",
        "See the GNU Affero General Public License for more details.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "isc-warranty": [
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ],
    "mit": [
        "Released under the MIT License.", "Licensed under the MIT License.", "{} licensed under the MIT License.", "{} released under the MIT License.",
        "{} licensed under the terms of the MIT License.",
    ],
    "mit-grant": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-warranty": [
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ],
    "mit-liability": [
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "mpl2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl2-copy": [
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "zlib-origin": [
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    ],
    "zlib-altered": ["Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."],
    "zlib-notice": ["This notice may not be removed or altered from any source distribution."],
}

_APACHE = ["apache-use", "apache-copy", "apache-basis", "apache-see"]
_BSD, _BSD_END = ["bsd-use", "bsd-source", "bsd-binary"], ["bsd-disclaimer", "bsd-liability"]
_MIT = ["mit-grant", "mit-notice"]
# Identifiers that a licence's text or notice has in this order.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["apache"]), ("Apache-2.0", _APACHE),
    ("BSD-2-Clause", _BSD), ("BSD-2-Clause", _BSD + _BSD_END), ("BSD-3-Clause", [*_BSD, "bsd-name"]), ("BSD-3-Clause", [*_BSD, "bsd-name", *_BSD_END]),
    ("CC-BY-4.0", ["cc-by"]), ("CC-BY-NC-4.0", ["cc-by-nc"]), ("CC-BY-SA-4.0", ["cc-by-sa"]), ("CC0-1.0", ["cc0"]),
    ("AGPL-3.0-or-later", ["agpl3+"]), ("GPL-2.0-only", ["gpl2"]), ("GPL-2.0-or-later", ["gpl2+"]), ("GPL-3.0", ["gpl3"]),
    ("GPL-3.0-or-later", ["gpl3+"]), ("LGPL-2.1-or-later", ["lgpl2.1+"]), ("LGPL-3.0-or-later", ["lgpl3+"]),
    ("AGPL-3.0-or-later", ["agpl3+", "gnu-hope", "gnu-see"]), ("GPL-2.0-only", ["gpl2", "gnu-hope", "gnu-see"]),
    ("GPL-2.0-or-later", ["gpl2+", "gnu-hope", "gnu-see"]), ("GPL-3.0-or-later", ["gpl3+", "gnu-hope", "gnu-see"]),
    ("LGPL-2.1-or-later", ["lgpl2.1+", "gnu-hope", "gnu-see"]), ("LGPL-3.0-or-later", ["lgpl3+", "gnu-hope", "gnu-see"]),
    ("ISC", ["isc"]), ("ISC", ["isc", "isc-warranty"]),
    ("MIT", ["mit"]), ("MIT", _MIT), ("MIT", [*_MIT, "mit-warranty", "mit-liability"]),
    ("MPL-2.0", ["mpl2"]), ("MPL-2.0", ["mpl2", "mpl2-copy"]), ("Unlicense", ["unlicense"]),
    ("Zlib", ["zlib-origin", "zlib-altered", "zlib-notice"]),
]
# A licence named by a tag in a source file.
TAG = "SPDX-License-Identifier: "

# Words that a hole takes at most, and the share of a sentence's words that make another one nearly it.
HOLE_WORDS = 12
NEAR = 0.5
# Each sentence above has one of these in a word of it, in lower case.
ANCHORS = ("licens", "copyright", "permission", "redistribut", "domain", "misrepresented", "altered", "warrant", "disclaim", "liab")

_WORD = re.compile(r"[^\W_]+")
_BORDER = re.compile(r"(?<=[.!?;:])\s+|\n\s*")
_END = re.compile(r"[.!?;:]\s+")
# What stands before the first word of a sentence: marks of comments and lists.
_MARK = re.compile(r"[^\w\n]*(?:\b(?:\d{1,2}|[a-zA-Z]|[ivx]{1,4})[.)]\s+)?")
_HOLE = object()


def normal_words(sentence: str) -> list[str]:
    """Letters and digits in lower case, all else parts words."""
    return _WORD.findall(sentence.lower())


def pattern_words(form: str) -> list:
    """Words of a known sentence, _HOLE for each `{}`."""
    parts = form.split("{}")
    out: list = normal_words(parts[0])
    for part in parts[1:]:
        out += [_HOLE, *normal_words(part)]
    return out


def with_tags(sentences: dict[str, list[str]], rules: list[tuple[str, list[str]]]) -> tuple[dict, list]:
    """Sentences and rules with a tag for every licence that the rules name."""
    names = sorted({name for name, _ in rules})
    return sentences | {f"tag {n}": [TAG + n] for n in names}, rules + [(n, [f"tag {n}"]) for n in names]


def anchors_of(sentences: dict[str, list[str]]) -> set[str] | None:
    """For each sentence a piece of one of its words, so that white space does not matter; None if one has none."""
    out = set()
    for words in (pattern_words(x) for forms in sentences.values() for x in forms):
        plain = [w for w in words if w is not _HOLE and w.isascii()]
        known = [a for a in ANCHORS if any(a in w for w in plain)]
        if not plain:
            return None
        out.add(known[0] if known else max(plain, key=len))
    return out


class Rules:
    """Word trie of the known sentences, and the identifier sequence of every licence."""

    def __init__(self, sentences: dict[str, list[str]], rules: list[tuple[str, list[str]]]):
        self.trie: dict = {}
        self.words: dict[str, list[set]] = {}
        for name, forms in sentences.items():
            for form in forms:
                node, words = self.trie, pattern_words(form)
                for w in words:
                    node = node.setdefault(w, {})
                node[None] = name
                self.words.setdefault(name, []).append({w for w in words if w is not _HOLE})
        # The longest rule wins where several begin.
        self.rules = sorted(rules, key=lambda x: -len(x[1]))

    def _longest(self, text: str, start: int, ends: set[int]):
        """(identifier, end) of the longest known sentence from `start`; of two with one end that with fewer words in holes."""
        states, best = [(self.trie, 0, 0)], None
        # A hole at the front takes words of the same sentence only.
        first = _MARK.match(text, start).end()
        front, stop_at = self.trie.get(_HOLE), _END.search(text, first)
        limit = stop_at.end() if stop_at else len(text)
        for m in _WORD.finditer(text, first):
            word, after = m.group().lower(), {}
            for node, inside, taken in states:
                if inside and node is front and m.start() >= limit:
                    continue
                for step in (
                    (node[word], 0, taken) if word in node else None,
                    (node[_HOLE], 1, taken + 1) if _HOLE in node else None,
                    (node, inside + 1, taken + 1) if 0 < inside < HOLE_WORDS else None,
                ):
                    if step and (id(step[0]), step[1]) not in after:
                        after[id(step[0]), step[1]] = step
            states = list(after.values())
            if not states:
                break
            done = [(taken, node[None]) for node, inside, taken in states if None in node and not inside]
            if done:
                stop = m.end()
                while stop < len(text) and stop not in ends and not text[stop].isalnum():
                    stop += 1
                if stop in ends:
                    best = min(done)[1], stop
        return best

    def sentences(self, text: str) -> tuple[list[tuple[str, int, int]], list[int]]:
        """(identifier, start, end) of known sentences that begin and end at a border, and all borders."""
        borders = [0, *[m.end() for m in _BORDER.finditer(text)]]
        ends = {len(text)} | {m.start() for m in _BORDER.finditer(text)}
        out, free = [], 0
        for start in borders:
            if start >= free and (best := self._longest(text, start, ends)):
                out.append((best[0], start, best[1]))
                free = best[1]
        return out, borders

    @staticmethod
    def _adjoin(text: str, a: int, b: int) -> bool:
        """True if only marks stand between two sentences."""
        return not _WORD.search(_MARK.sub("", text[a:b].strip(), count=1)) or not text[a:b].strip()

    def match(self, text: str) -> list[tuple[str, int, int, int, bool]]:
        """(licence, start, end, sentences, exact) of every rule whose sentences follow each other in the text.

        Where the text goes on with nearly the sentence that a longer rule has next, the longer rule's
        licence is named instead, as not exact.
        """
        found, _ = self.sentences(text)
        out, i = [], 0
        while i < len(found):
            run = 1
            while i + run < len(found) and self._adjoin(text, found[i + run - 1][2], found[i + run][1]):
                run += 1
            ids = [x[0] for x in found[i : i + run]]
            for name, sequence in self.rules:
                if ids[: len(sequence)] == sequence:
                    last = found[i + len(sequence) - 1]
                    near = self._near(text, last[2], ids, sequence)
                    out.append((near or name, found[i][1], last[2], len(sequence), near is None))
                    i += len(sequence)
                    break
            else:
                i += 1
        return out

    def _near(self, text: str, at: int, ids: list[str], sequence: list[str]) -> str | None:
        """Licence of a longer rule if the words from `at` are nearly those of its next sentence."""
        for name, longer in self.rules:
            if len(longer) > len(sequence) and longer[: len(sequence)] == sequence:
                for words in self.words[longer[len(sequence)]]:
                    ahead = set()
                    for m in _WORD.finditer(text, at):
                        ahead.add(m.group().lower())
                        if len(ahead) >= len(words):
                            break
                    if len(words & ahead) >= NEAR * len(words):
                        return name
        return None


def recognise(
    docs: DataFrame, sentences: dict[str, list[str]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES
) -> DataFrame:
    """One row per licence found: doc_id, license, start, length (characters), n_sentences, exact.

    A text is cut into sentences at end marks and line ends; a sentence may run over lines. Sentences are
    compared by their lower-case words, so marks of comments and bullets do not count, nor does the number
    of a list item. Known ones become identifiers, and where identifiers follow each other with nothing
    between as a licence's rule asks, the licence is reported, the longest rule first; `exact` is false
    where the text goes on with an altered sentence of a longer rule. Texts without any of the rules'
    anchors cannot hold a known sentence and stay in the JVM. Null and empty texts and texts without a
    licence give no row; a licence that comes twice gives two, as does a repeated row.
    """
    sentences, rules = with_tags(sentences, rules)
    lower = F.lower(F.col("text").cast("string"))
    anchors = anchors_of(sentences)
    hit = F.lit(anchors is None)
    for anchor in sorted(anchors or ()):
        hit = hit | F.contains(lower, F.lit(anchor))

    def run(batches):
        known = Rules(sentences, rules)
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for x in known.match(text):
                    rows.append(i)
                    found.append(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())), pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] - x[1] for x in found], pa.int64()),
                    pa.array([x[3] for x in found], pa.int64()), pa.array([x[4] for x in found], pa.bool_()),
                ],
                ["doc_id", "license", "start", "length", "n_sentences", "exact"],
            )

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return held.filter(hit).mapInArrow(run, "doc_id long, license string, start long, length long, n_sentences long, exact boolean")
