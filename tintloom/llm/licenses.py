"""License scans by matching templates with optional and replaceable regions.

A template is wording with markup: [[ ... ]] encloses a region that may be left out, <n> stands for up to n words
of any kind, such as a holder's name. Each template becomes a small automaton over words; a text is accepted
where, from some word on, all mandatory wording follows exactly, and the longest such stretch is what is noted. A plain
phrase is a template without regions. Notices are known in two ways: by their opening clause, which may go on
differently, and whole to their last word.

Null and empty texts have no words and no matches: n_words 0, n_base 0, first and last null, labels empty, score 0.
Overlapping places all count. Rows that repeat give results that repeat; texts of any length are scanned whole.
A null doc_id stays null. An empty table gives an empty result. Only doc_id and text are read, whatever other columns
are named.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_of, small_batches, table, text_of

# The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label and template of names and opening clauses, beyond the base phrases.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license [[,]] version 2.0 [[the license]]"),
    ("apache-2.0", "spdx license identifier apache 2.0"),
    ("gpl-notice", "this <4> is free software [[;]] you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[affero]] general public license as published by the free software foundation"),
    ("gpl-3.0", "gnu general public license [[,]] version 3 [[or [[at your option]] [[any]] later [[version]]]]"),
    ("gpl-2.0", "gnu general public license [[,]] version 2 [[or [[at your option]] [[any]] later [[version]]]]"),
    ("gpl-3.0", "spdx license identifier gpl 3.0 [[only]] [[or later]]"),
    ("gpl-2.0", "spdx license identifier gpl 2.0 [[only]] [[or later]]"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this <6> and associated documentation files [[the <3>]] to deal in the <3> without restriction"),
    ("mit-notice", "released under the mit license"),
    ("mit-notice", "spdx license identifier mit"),
    ("cc-by-4.0", "creative commons attribution 4.0 [[international]] [[public]] license"),
    ("cc-by-4.0", "cc by 4.0"),
    ("cc-by-sa", "cc by sa [[<2>]]"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license [[v]] 2.0"),
]

_BSD_CONDITIONS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[and]] "
    "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution "
)
_BSD_DISCLAIMER = (
    "this software is provided by <14> and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall <12> be liable for any direct indirect "
    "incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
    "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict "
    "liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
    "possibility of such damage"
)
#: Label and template of notices from their first word to their last.
WHOLE = [
    ("mit-text", (
        "permission is hereby granted free of charge to any person obtaining a copy of this <6> and associated documentation files [[the <3>]] "
        "to deal in the <3> without restriction including without limitation the rights to use copy modify merge publish distribute "
        "sublicense and or sell copies of the <3> and to permit persons to whom the <3> is furnished to do so subject to the following "
        "conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies "
        "or substantial portions of the <3> the <3> is provided <2> without warranty of any kind express or implied including but not "
        "limited to the warranties of merchantability fitness for a particular purpose and <2> in no event shall the <8> be liable for any "
        "claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the "
        "<3> or the use or other dealings in the <3>"
    )),
    ("bsd-2-clause-text", _BSD_CONDITIONS + _BSD_DISCLAIMER),
    ("bsd-3-clause-text", _BSD_CONDITIONS + (
        "[[3]] neither the name of <12> nor the names of [[its]] [[the]] [[other]] contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission "
    ) + _BSD_DISCLAIMER),
    ("isc-text", (
        "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided "
        "that the above copyright notice and this permission notice appear in all copies the software is provided <2> and <4> disclaims "
        "all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <4> "
        "be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or "
        "profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or "
        "performance of this software"
    )),
    ("apache-2.0-text", (
        "licensed under the apache license version 2.0 the <1> you may not use this <4> except in compliance with the license you may obtain "
        "a copy of the license at <2> apache org licenses license 2.0 [[html]] [[txt]] unless required by applicable law or agreed to in writing software "
        "distributed under the license is distributed on an <2> basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license"
    )),
    ("gpl-text", (
        "this <4> is free software you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[affero]] general public "
        "license as published by the free software foundation [[either]] version <2> of the license [[or at your option any later version]] "
        "this <4> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu [[lesser]] [[affero]] general public license for more details "
        "[[you should have received a copy of the gnu [[lesser]] [[affero]] general public license along with this <4> if not "
        "[[see <2> www gnu org licenses]] [[write to the free software foundation [[inc]] <14> usa]]]]"
    )),
]

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of digits, letters lower-cased in A-Z, and characters beyond ASCII, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


class Automaton:
    """A template's automaton. Edges lead from a state, by a word or (None) by any word; skips need no word."""

    def __init__(self, template: str):
        self.edges: list[dict[bytes | None, set[int]]] = [{}]
        self.skips: list[set[int]] = [set()]
        tokens = re.findall(r"\[\[|\]\]|<\d+>|[^\s\[\]<>]+", template)
        opened: list[int] = []
        at, lead, leading = 0, [], True
        for token in tokens:
            if token == "[[":
                opened.append(at)
                leading = False
            elif token == "]]":
                self.skips[opened.pop()].add(at)
            elif token[0] == "<":
                leading = False
                begin = at
                for _ in range(int(token[1:-1])):
                    at = self._step(at, None)
                    self.skips[begin].add(at)
                    begin = at
            else:
                for word in words_of(token):
                    at = self._step(at, word)
                    if leading:
                        lead.append(word)
        if opened or not lead:
            raise ValueError(f"a template must open with mandatory words and close its regions: {template}")
        self.end = at
        #: The mandatory words a match begins with: places are looked up by them.
        self.lead = b" " + b" ".join(lead) + b" "
        self.plain = len(lead) == at

    def _step(self, at: int, word: bytes | None) -> int:
        self.edges.append({})
        self.skips.append(set())
        self.edges[at].setdefault(word, set()).add(len(self.edges) - 1)
        return len(self.edges) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips[todo.pop()] - states:
                states.add(s)
                todo.append(s)
        return states

    def longest(self, words: list[bytes], at: int) -> int | None:
        """The word behind the longest stretch from word `at` on that has all mandatory wording; None if there is none."""
        states, end = self._closed({0}), None
        while True:
            if self.end in states:
                end = at
            if not states or at >= len(words):
                return end
            word, at = words[at], at + 1
            states = self._closed({t for s in states for k in (word, None) for t in self.edges[s].get(k, ())})

    def places(self, words: list[bytes], joined: bytes) -> list[tuple[int, int]]:
        """The words at which a match begins and before which it ends. joined: the words, each with a blank before, and one at the end."""
        found, at, counted, index = [], joined.find(self.lead), 0, 0
        while at >= 0:
            index += joined.count(b" ", counted, at)
            counted = at
            end = index + len(self.lead.split()) if self.plain else self.longest(words, index)
            if end is not None:
                found.append((index, end))
            at = joined.find(self.lead, at + 1)
        return found


NOTICE = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())])


def scan(
    docs: DataFrame, *, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, whole: list[tuple[str, str]] | None = None
) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices).

    n_base, first_word, last_word and base_labels tell of the phrases; labels adds those of accepted templates, and
    notices says where: label, first word of each and the word behind its last one. score: 1 with a whole notice, 0.75
    with another template, 0.5 with phrases alone, else 0. One narrow pass: no shuffle.
    """
    small_batches(docs.sparkSession)
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    whole = WHOLE if whole is None else whole

    def run(batches):
        base = [(label, Automaton(p)) for p, label in phrases.items()]
        more = [[(label, Automaton(t)) for label, t in some] for some in (templates, whole)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(NOTICE)]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                joined = b" " + b" ".join(words) + b" "
                at = [(label, i) for label, a in base for i, _ in a.places(words, joined)]
                named, full = ([(label, *span) for label, a in some for span in a.places(words, joined)] for some in more)
                own = {label for label, _ in at}
                index = [i for _, i in at]
                rows.append((
                    len(words), len(at), min(index, default=None), max(index, default=None), ",".join(sorted(own)),
                    ",".join(sorted(own | {label for label, _, _ in named + full})), 1.0 if full else 0.75 if named else 0.5 if at else 0.0,
                    [dict(zip(NOTICE.names, x, strict=True)) for x in sorted(named + full, key=lambda x: (*x[1:], x[0]))],
                ))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["doc_id", *map(str, range(8))])

    return docs.select(id_of().alias("doc_id"), text_of().alias("text")).mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "notices array<struct<label: string, first_word: long, end_word: long>>",
    )


def op9_license_templates(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents")).drop("notices")
