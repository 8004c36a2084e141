"""Licence scan with a positional rare-token index.

Templates are short licence notices. Their words are weighed by inverse document frequency, counted over the whole
corpus. Of each template the highest-weighted words of its first mandatory key phrase are looked up; the postings
(template, position) of each occurrence vote for where the template would start, so hits that agree in relative
position pile up on one start. The phrase has to be there, so a start that all of these words vote for is verified,
whatever else the file holds. A template is reported where enough of its words stand in place and each of its mandatory
key phrases is found word for word at its own position. A template that the file cuts off at its beginning may lack any
of its words, so there all of the file's first words vote with their weights. The listed base phrases are searched for exactly, everywhere.

Defined cases: null and empty texts have no words and no labels, score 0; matches overlap freely; equal votes are
settled by template and position; repeated rows are scanned alike; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import slices

# fixed values: phrases and labels that the scan must report
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# fixed values: label, wording of a public licence notice, its mandatory phrases
TEMPLATES = {
    "mit": ("released under the mit license", ["mit license"]),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files to deal in the software without restriction",
        ["permission is hereby granted free of charge"],
    ),
    "apache-2": ("licensed under the apache license version 2 0", ["apache license version 2"]),
    "gpl-3": ("this work is licensed under the gnu general public license version 3", ["general public license version 3"]),
    "gpl-2": ("licensed under the gnu general public license version 2", ["general public license version 2"]),
    "lgpl-3": ("licensed under the gnu lesser general public license version 3", ["lesser general public license"]),
    "cc-by-nc": ("licensed under cc by nc 4 0", ["cc by nc"]),
    "cc-by-sa": ("licensed under cc by sa 4 0", ["cc by sa"]),
    "bsd-3": (
        "redistribution and use in source and binary forms with or without modification are permitted",
        ["redistribution and use in source and binary forms"],
    ),
    "mpl-2": ("subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    "bsd-2-conditions": (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following "
        "disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and "
        "the following disclaimer in the documentation and or other materials provided with the distribution",
        ["redistributions of source code must retain", "redistributions in binary form must reproduce"],
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies the software is "
        "provided as is and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness",
        ["permission to use copy modify and or distribute this software"],
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held "
        "liable for any damages arising from the use of this software permission is granted to anyone to use this software "
        "for any purpose including commercial applications and to alter it and redistribute it freely subject to the "
        "following restrictions the origin of this software must not be misrepresented you must not claim that you wrote "
        "the original software altered source versions must be plainly marked as such and must not be misrepresented as "
        "being the original software this notice may not be removed or altered from any source distribution",
        ["the origin of this software must not be misrepresented"],
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
        "compile sell or distribute this software either in source code form or as a compiled binary for any purpose "
        "commercial or non commercial and by any means",
        ["free and unencumbered software released into the public domain"],
    ),
    "apache-2-notice": (
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www "
        "apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed "
        "under the license is distributed on an as is basis without warranties or conditions of any kind either express or "
        "implied see the license for the specific language governing permissions and limitations under the license",
        ["www apache org licenses license 2 0"],
    ),
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 3 of the license or at your option any later "
        "version this program is distributed in the hope that it will be useful but without any warranty without even the "
        "implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for "
        "more details",
        ["as published by the free software foundation"],
    ),
}
#: Words of each template's key phrase that are looked up, by weight; a start that all of them vote for is verified.
LOOKED_UP = 3
#: Share of a template's weight that must stand in place.
MATCH = 0.6
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def document_frequency(docs: DataFrame, words: list[str]) -> tuple[int, dict[str, int]]:
    """Documents, and documents holding each template word; one row per template word reaches the driver."""
    listed = F.array(*map(F.lit, words))
    found = F.array_intersect(F.split(F.lower(F.coalesce("text", F.lit(""))), SEPARATORS), listed)
    counts = docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    return docs.count(), {r["word"]: r["n"] for r in counts}


class _Index:
    def __init__(self, templates: dict, n_docs: int, df: dict[str, int]):
        self.words = {label: notice.split() for label, (notice, _) in templates.items()}
        self.keys = {label: [k.split() for k in keys] for label, (_, keys) in templates.items()}
        self.postings: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for label, words in self.words.items():
            for at, word in enumerate(words):
                self.postings[word].append((label, at))
        self.weight = {w: math.log1p((n_docs + 1) / (1 + df.get(w, 0))) for w in self.postings}
        self.total = {label: sum(self.weight[w] for w in words) for label, words in self.words.items()}
        self.places = {
            label: [next(i for i in range(len(n)) if n[i : i + len(k)] == k) for k in self.keys[label]]
            for label, n in self.words.items()
        }
        #: Words of each template to be looked up, with their places.
        self.rare: dict[str, list[tuple[str, int]]] = {}
        for label, words in self.words.items():
            first = range(self.places[label][0], self.places[label][0] + len(self.keys[label][0]))
            chosen = sorted(first, key=lambda i: (-self.weight[words[i]], i))[:LOOKED_UP]
            self.rare[label] = [(words[i], i) for i in chosen]
        self.longest = max(map(len, self.words.values()))

    def scan(self, words: list[str], here: set[str]) -> dict[str, float]:
        """Label and weighted share in place of each verified template; ``here`` are the template words in ``words``."""
        starts = set()
        for label, rare in self.rare.items():
            if all(w in here for w, _ in rare):
                votes: Counter = Counter()
                for word, place in rare:
                    votes.update(at - place for at, w in enumerate(words) if w == word)
                starts |= {(label, start) for start, n in votes.items() if start >= 0 and n == len(rare)}
        # cut off at the beginning of the file
        weights: dict[tuple[str, int], float] = defaultdict(float)
        for at, word in enumerate(words[: self.longest]):
            for label, place in self.postings.get(word, ()):
                if place > at:
                    weights[label, at - place] += self.weight[word]
        starts |= {(label, start) for (label, start), w in weights.items() if w >= MATCH * self.total[label] * (1 - 1e-9)}
        found: dict[str, float] = {}
        for label, start in starts:
            notice = self.words[label]
            span = range(max(0, -start), min(len(notice), len(words) - start))
            inside = sum(self.weight[notice[i]] for i in span if words[start + i] == notice[i])
            if inside >= MATCH * self.total[label] and all(
                words[start + i : start + i + len(k)] == k
                for k, i in zip(self.keys[label], self.places[label], strict=True)
                if start + i >= 0
            ):
                found[label] = max(found.get(label, 0.0), min(1.0, inside / self.total[label]))
        return found


def scan(docs: DataFrame, templates: dict | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every document."""
    templates, base = templates or TEMPLATES, base or BASE
    index = _Index(templates, *document_frequency(docs, sorted({w for t, _ in templates.values() for w in t.split()})))
    phrases = [(p.split(), label) for p, label in base.items()]
    word = re.compile(rb"[0-9a-z\x80-\xff]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column(1).to_pylist():
                words = [w for w in word.findall((text or "").encode("utf-8", "surrogatepass").lower())]
                here = {w.decode() for w in _ASCII & set(words)}
                places, labels, found = [], set(), {}
                if here:
                    plain = [w.decode("utf-8", "replace") for w in words]
                    for phrase, label in phrases:
                        if here.issuperset(phrase):
                            at = [i for i, w in enumerate(plain) if w == phrase[0]]
                            at = [i for i in at if plain[i : i + len(phrase)] == phrase]
                            places += at
                            labels |= {label} if at else set()
                    found = index.scan(plain, here)
                rows.append(
                    (
                        len(words),
                        len(places),
                        min(places, default=None),
                        max(places, default=None),
                        ",".join(sorted(labels)),
                        ",".join(sorted(labels | found.keys())),
                        1.0 if labels else max(found.values(), default=0.0),
                    )
                )
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    _ASCII = frozenset(w.encode() for w in index.weight.keys() | {w for p, _ in phrases for w in p})
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long"
    return docs.select("doc_id", "text").mapInArrow(run, f"{schema}, base_labels string, labels string, score double")
