"""License scans by template-markup matching.

Method. A template is licence wording with markup: `[[words]]` may be missing, `{{n}}` stands for up to n
words of any kind, and all else is mandatory. Templates are compiled into token automata over lower-case
words, so case, punctuation and layout do not matter; a text is accepted where its words run through an
automaton, so mandatory wording must match word for word: a licence whose conditions or disclaimer were changed is not
accepted. The texts of short licences are whole templates; one-line notices are templates of their own. An automaton
is started only in texts that hold its rarest mandatory word and only at words it can begin with. Base phrases are
looked for beside this.

A null or empty text has no words and no labels. Labels found more than once are named once; every match is listed.
Every row gets a result of its own, repeated rows too; no rows meet, and extra columns are ignored. A very long text is
one block of its own, whose words are kept only if it holds some template's rarest word.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.textcore import LOWER, byte_table, giving_back, per_text, span_hash, text_blocks, text_of, words

NOT_WORD = byte_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Labels, the word that every accepted text holds, and the wording with markup.
TEMPLATES = (
    ("apache-2.0", "apache", "licensed under [[the terms of]] the apache license version 2 [[0]] [[the license]]"),
    ("mit", "mit", "[[this {{3}} is]] [[released]] [[licensed]] under [[the terms of]] the mit license"),
    (
        "mit", "sublicense",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
        "software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all "
        "copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and [[noninfringement]] [[non infringement]] in no event shall {{8}} be liable for any claim damages or other liability whether in an "
        "action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("gpl-3.0", "gnu", "[[this {{3}} is]] licensed under the [[terms of the]] gnu general public license version 3 [[0]] [[or later]]"),
    ("gpl-2.0", "gnu", "[[this {{3}} is]] licensed under the [[terms of the]] gnu general public license version 2 [[0]] [[or later]]"),
    (
        "gpl-notice", "gnu",
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {{2}} of the "
        "license or [[at your option]] any later version {{6}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability "
        "or fitness for a particular purpose see the gnu general public license for more details",
    ),
    ("lgpl", "lesser", "licensed under the [[terms of the]] gnu lesser general public license [[version {{2}}]]"),
    (
        "bsd", "redistributions",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must "
        "retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of "
        "conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[ [[3]] neither the name of {{12}} nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission ]] this software is provided by {{10}} as is and any "
        "express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{10}} be "
        "liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or "
        "profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out "
        "of the use of this software even if advised of the possibility of such damage",
    ),
    ("bsd", "bsd", "[[released]] [[licensed]] under [[the terms of]] the bsd [[2 clause]] [[3 clause]] license"),
    (
        "isc", "fee",
        "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
        "notice appear in all copies the software is provided as is and {{8}} disclaims all warranties with regard to this software including all implied warranties of merchantability and "
        "fitness in no event shall {{8}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an "
        "action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    ("cc-by-4.0", "cc", "licensed under [[a]] [[creative commons]] cc by 4 0"),
    ("cc-by-sa-4.0", "cc", "licensed under [[a]] [[creative commons]] cc by sa 4 0"),
    ("cc-by-nc-4.0", "cc", "licensed under [[a]] [[creative commons]] cc by nc 4 0"),
    ("cc-by-nd-4.0", "cc", "licensed under [[a]] [[creative commons]] cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "cc", "licensed under [[a]] [[creative commons]] cc by nc sa 4 0"),
    ("cc0-1.0", "cc0", "[[licensed]] [[released]] under [[the]] cc0 [[1 0]] [[universal]]"),
    ("rights-notice", "reserved", "copyright {{6}} all rights reserved"),
)

ANY = None


class Automaton:
    """A token automaton: from each state, words that lead on (ANY: all) and moves without a word."""

    def __init__(self, markup: str):
        self.step: list[tuple[str | None, int] | None] = [None]
        self.free: list[list[int]] = [[]]
        opened: list[int] = []
        at = 0
        for mark, many, word in re.findall(r"(\[\[|\]\])|\{\{(\d+)\}\}|([^\s\[\]{}]+)", markup):
            if mark == "[[":
                opened.append(at)
            elif mark == "]]":
                self.free[opened.pop()].append(at)
            elif many:
                gaps = []
                for _ in range(int(many)):
                    gaps.append(at)
                    at = self._word(at, ANY)
                for g in gaps:
                    self.free[g].append(at)
            else:
                at = self._word(at, word)
        if opened:
            raise ValueError(f"unclosed region: {markup}")
        self.end = at
        self.start = self._closure({0})
        if self.end in self.start:
            raise ValueError(f"nothing mandatory: {markup}")

    def _word(self, at: int, word: str | None) -> int:
        new = len(self.step)
        self.step.append(None)
        self.free.append([])
        self.step[at] = (word, new)
        return new

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    @property
    def leads(self) -> set[str | None]:
        return {self.step[s][0] for s in self.start if self.step[s]}

    def match(self, tokens: list[str], at: int) -> int | None:
        """The end of the longest accepted run of words from `at`."""
        states, best = self.start, None
        for i in range(at, len(tokens)):
            states = self._closure({self.step[s][1] for s in states if self.step[s] and self.step[s][0] in (ANY, tokens[i])})
            if not states:
                break
            if self.end in states:
                best = i + 1
        return best


@functools.lru_cache(1)
def _compiled() -> list[tuple[str, str, Automaton]]:
    return [(label, word, Automaton(markup)) for label, word, markup in TEMPLATES]


def _hash(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    return span_hash(raw, np.array([0]), np.array([len(raw)]))[0]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score and matches.

    matches holds label, start and end (words from 0, end excluded) of every accepted template. The score is
    1 where a template accepts, 0.5 where only a base phrase stands, 0 elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = [([_hash(w) for w in p.split()], label) for p, label in PHRASES.items()]
        templates = [(label, _hash(word), a, None if ANY in a.leads else np.array([_hash(w) for w in a.leads])) for label, word, a in _compiled()]
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(1)):
                low = LOWER[data]
                starts, ends, first = words(low, offsets, NOT_WORD)
                h, text, n = span_hash(low, starts, ends), text_of(starts, first), b - a
                places, labels, matches = np.zeros(len(h), np.int64), [set() for _ in range(n)], [[] for _ in range(n)]
                for parts, label in phrases:
                    ok = np.zeros(len(h), bool)
                    m = len(h) - len(parts) + 1
                    if m > 0:
                        ok[:m] = text[:m] == text[len(parts) - 1 :]
                        for k, x in enumerate(parts):
                            ok[:m] &= h[k : k + m] == x
                    places += ok
                    for i in np.unique(text[ok]).tolist():
                        labels[i].add(label)
                base = [sorted(x) for x in labels]
                tokens: dict[int, list[str]] = {}
                for label, word, automaton, leads in templates:
                    for i in np.unique(text[h == word]).tolist():
                        x, y = int(first[i]), int(first[i + 1])
                        if i not in tokens:
                            raw = low[offsets[i] : offsets[i + 1]].tobytes()
                            s0 = int(offsets[i])
                            tokens[i] = [raw[s - s0 : e - s0].decode("utf-8", "replace") for s, e in zip(starts[x:y].tolist(), ends[x:y].tolist())]
                        near = range(y - x) if leads is None else np.flatnonzero(np.isin(h[x:y], leads)).tolist()
                        for at in near:
                            end = automaton.match(tokens[i], at)
                            if end is not None:
                                labels[i].add(label)
                                matches[i].append({"label": label, "start": at, "end": end})
                count = per_text(places, first)
                at = np.flatnonzero(places)
                lead, last = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
                last[text[at]] = at - first[text[at]]
                lead[text[at][::-1]] = (at - first[text[at]])[::-1]
                score = [1.0 if m else 0.5 if c else 0.0 for m, c in zip(matches, count.tolist())]
                none = count == 0
                yield pa.record_batch(
                    [
                        batch.column(0).slice(a, n), pa.array(np.diff(first)), pa.array(count), pa.array(lead, mask=none), pa.array(last, mask=none),
                        pa.array([",".join(x) for x in base], pa.string()), pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(score, pa.float64()),
                        pa.array(matches, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
                    ],
                    names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
                )

    rows = docs.select(docs[id_col].cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return rows.mapInArrow(
        giving_back(run),
        f"`{id_col}` long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "matches array<struct<label:string,start:long,end:long>>",
    )
