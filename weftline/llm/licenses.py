"""License scans by template-markup matching: templates become token automata."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACED = bytes(c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 97 + c - 65 if 65 <= c <= 90 else 32 for c in range(256))

# Phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Markup: [[a|b]] for wording that may be absent, ((a|b)) for wording of which one must stand, {{n}} for 1 to n words of any kind;
# all else must stand as it is. First grants and notices, which are enough to name a license, then whole texts.
_BSD_HEAD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[[1|a]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[[2|b]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_BSD_NAMES = "[[3|c]] neither the ((name|names)) of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "
_BSD_TAIL = (
    "this software is provided by {{8}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall {{8}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_GNU = "is free software you can redistribute it and or modify it under the terms of the gnu {0} general public license as published by the free software foundation ((either version|version)) {{{{2}}}} [[of the license]]"
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction"),
    ("mit", "[[this {{3}} is]] [[released|licensed|distributed]] under the [[terms of the]] mit license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("apache-2", "licensed under the apache license version 2 [[0]] [[the license]]"),
    ("gpl", "licensed under the [[terms of the]] gnu general public license [[version {{1}}]]"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the [[terms of the]] gnu ((lesser|library)) general public license [[version {{1}}]]"),
    ("lgpl", "under the terms of the gnu ((lesser|library)) general public license as published by the free software foundation"),
    ("agpl", "licensed under the [[terms of the]] gnu affero general public license [[version {{1}}]]"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2", "subject to the terms of the mozilla public license [[v {{2}}|version {{2}}]]"),
    ("cc-by-nc", "licensed under [[a]] ((cc by nc|creative commons attribution noncommercial)) [[{{1}} {{1}}]] [[international]] [[license]]"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    ("bsd-2-clause", _BSD_HEAD + _BSD_TAIL),
    ("bsd-3-clause", _BSD_HEAD + _BSD_NAMES + _BSD_TAIL),
    (
        "zlib-text",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "[[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "[[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution",
    ),
    (
        "apache-2-notice",
        "licensed under the apache license version 2 [[0]] [[the license]] you may not use this file except in compliance with the license you may obtain a copy of the license at [[http|https]] www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    ("gpl-notice", _GNU.replace("{0} ", "").format() + " [[or at your option any later version]]"),
    ("lgpl-notice", _GNU.format("((lesser|library))") + " [[or at your option any later version]]"),
    ("agpl-notice", _GNU.format("affero") + " [[or at your option any later version]]"),
    ("mpl-2-notice", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at [[http|https]] [[www]] mozilla org mpl 2 0"),
    (
        "unlicense-text",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
)


def compiled(markup: str):
    """(edges, end, length): edges[state] is a list of (word, next); word None: any word, False: none is read. length: mandatory words."""
    edges: list[list] = [[]]

    def state():
        edges.append([])
        return len(edges) - 1

    def line(words, at):
        for w in words:
            if m := re.fullmatch(r"\{\{(\d+)\}\}", w):
                ends = []
                for _ in range(int(m[1])):
                    nxt = state()
                    edges[at].append((None, nxt))
                    ends.append(nxt)
                    at = nxt
                to = state()
                for e in ends:
                    edges[e].append((False, to))
                at = to
            else:
                nxt = state()
                edges[at].append((w.encode(), nxt))
                at = nxt
        return at

    at, length = 0, 0
    for m in re.finditer(r"\[\[(.*?)\]\]|\(\((.*?)\)\)|(\S+)", markup):
        if m[3]:
            at = line([m[3]], at)
            length += 1
            continue
        to = state()
        if m[1] is not None:
            edges[at].append((False, to))
        for way in (m[1] or m[2]).split("|"):
            edges[line(way.split(), at)].append((False, to))
        at = to
    return edges, at, length


def _closure(edges, states):
    todo, out = list(states), set(states)
    while todo:
        for word, nxt in edges[todo.pop()]:
            if word is False and nxt not in out:
                out.add(nxt)
                todo.append(nxt)
    return out


def as_regex(markup: str) -> str:
    """The same wording as a regular expression over words that follow a space each."""
    out = ""
    for m in re.finditer(r"\[\[(.*?)\]\]|\(\((.*?)\)\)|(\S+)", markup):
        ways = ["".join(rf"(?: [^ ]+){{1,{n[1]}}}" if (n := re.fullmatch(r"\{\{(\d+)\}\}", w)) else " " + w for w in way.split()) for way in ([m[3]] if m[3] else (m[1] or m[2]).split("|"))]
        out += ways[0] if m[3] else f"(?:{'|'.join(ways)})" + "?" * (m[1] is not None)
    return out + " "


class Automaton:
    def __init__(self, label: str, markup: str):
        self.label, (self.edges, self.end, self.length) = label, compiled(markup)
        self.first = {w for s in _closure(self.edges, {0}) for w, _ in self.edges[s] if w is not False}
        plain = re.sub(r"\[\[.*?\]\]|\(\(.*?\)\)", " ", markup).split()
        self.needs = {w.encode() for w in plain if not w.startswith("{{")}
        self.moves: dict = {}

    def accepts(self, words: list, at: int) -> bool:
        states = frozenset(_closure(self.edges, {0}))
        for k in range(at, len(words)):  # no longer than the template
            w = words[k]
            key = (states, w if any(w == x for s in states for x, _ in self.edges[s]) else None)
            if key not in self.moves:
                self.moves[key] = frozenset(_closure(self.edges, {n for s in states for x, n in self.edges[s] if x is None or x == key[1] and x is not False}))
            states = self.moves[key]
            if self.end in states:
                return True
            if not states:
                return False
        return False


AUTOMATA = tuple(Automaton(*t) for t in TEMPLATES)
#: Mandatory words of any template: a text with none of them fits no template.
NEEDED = frozenset().union(*(a.needs for a in AUTOMATA))


def words_of(text: bytes | None) -> list:
    return (text or b"").translate(_SPACED).split()


def scan_text(text: bytes | None) -> tuple:
    """(n_words, places of phrases [(word, label)], labels of templates, score)."""
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    places = []
    for phrase, label in PHRASES:
        probe, at, word = b" " + phrase.encode() + b" ", 0, 0
        while (to := line.find(probe, at)) >= 0:
            word += line.count(b" ", at, to)
            places.append((word, label))
            at, word = to + 1, word + 1
    labels, score = set(), 0.0
    have = NEEDED.intersection(words)
    for a in AUTOMATA if have else ():
        share = len(a.needs & have) / len(a.needs)
        if share == 1 and any(a.accepts(words, i) for i, w in enumerate(words) if w in a.first or None in a.first):
            labels.add(a.label)
            score = 1.0
        elif share >= 0.5:
            score = max(score, 0.5 * share)
    return len(words), sorted(places), labels, 1.0 if places else score


def _scanned(batches):
    for batch in batches:
        got = [scan_text(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        base = [",".join(sorted({x[1] for x in g[1]})) for g in got]
        both = [",".join(sorted({x[1] for x in g[1]} | g[2])) for g in got]
        starts = [[x[0] for x in g[1]] for g in got]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([g[0] for g in got], pa.int64()),
                pa.array([len(s) for s in starts], pa.int64()),
                pa.array([min(s, default=None) for s in starts], pa.int64()),
                pa.array([max(s, default=None) for s in starts], pa.int64()),
                pa.array(base, pa.string()),
                pa.array(both, pa.string()),
                pa.array([g[3] for g in got], pa.float64()),
            ],
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs.

    Phrases are found at every place. Templates run as automata over the words from each place where one can begin, and
    accept when all mandatory wording stood in order, optional regions were absent or as written, and replaceable
    ones had their number of words. score: 1 with a phrase or an accepted template, else half the largest share of a
    template's mandatory words that the text holds, from a share of a half on, else 0.

    Null or empty text: no words, no labels, score 0. Rows are independent: nothing is shuffled, long texts are read
    whole, repeated rows and null ids give a row each. Empty table: no rows. Other columns don't matter.
    """
    return docs.select("doc_id", "text").mapInArrow(_scanned, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
