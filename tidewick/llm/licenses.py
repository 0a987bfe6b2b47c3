"""License notices by a positional index of words.

The templates below are public notices, license names with their versions, and
SPDX identifiers. All their words are posted (word -> template, position) and
ranked by inverse document frequency, measured over ALL documents. A file looks up
the words it holds. Of each template of which it holds enough, its own highest-IDF
words, as many as a match can't all avoid, give the places where the template may
start; around those, all of the template's words vote. A template is a candidate
where ``SHARE`` of its words agree on a place within ``SLACK`` words, and counts if
its mandatory phrases stand in the window. A label of a family (gpl) stands beside
that of the version (gpl-3) where the notice gives one. SPDX expressions are read whole. Base phrases are found by
exact word match and keep their labels.

Defined results: null and empty texts have no words, no labels and score 0; an
empty table gives no rows; ties between places go to the first; repeated rows are
each scanned; extra columns are ignored. Score: 1 where a base phrase or an SPDX expression stands, else
the matched share of the best candidate's words.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SLACK = 3
SHARE = 0.6

#: Phrases and labels that are always reported.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Label, notice text, mandatory phrases.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included"]),
    ("mit", "released under the terms of the mit license", ["mit license"]),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ["apache license"]),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", ["distributed under the license is distributed on an as is basis"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use"]),
    ("bsd-2", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
     "this software is provided by the copyright holders and contributors as is", ["materials provided with the distribution this software is provided"]),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
     ["neither the name of", "endorse or promote products"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["gnu general public license"]),
    ("gpl", "this work is licensed under the gnu general public license version", ["gnu general public license"]),
    ("gpl-2", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license", "version 2 of the license"]),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license", "version 3 of the license"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("lgpl-2.1", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license", ["gnu lesser general public license", "version 2 1 of the license"]),
    ("lgpl-3", "gnu lesser general public license as published by the free software foundation either version 3 of the license", ["gnu lesser general public license", "version 3 of the license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["gnu affero general public license"]),
    ("agpl-3", "gnu affero general public license as published by the free software foundation either version 3 of the license", ["gnu affero general public license", "version 3 of the license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["mozilla public license"]),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license", "2 0"]),
    ("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", ["eclipse public license v1 0"]),
    ("cc-by", "this work is licensed under a creative commons attribution international license", ["creative commons attribution"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike international license", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license", ["attribution noncommercial"]),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives license", ["attribution noderivatives"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work", ["waived all copyright"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["public domain"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify"]),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ["altered source versions must be plainly marked"]),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["person or organization obtaining"]),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", ["sil open font license"]),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ["changing it is allowed"]),
]
#: Labels of license names with their versions, which stand word for word.
NAMES = {
    "gpl-2": ("gnu general public license version 2", "gnu general public license v2", "gnu gpl v2", "gplv2", "gpl 2 0"),
    "gpl-3": ("gnu general public license version 3", "gnu general public license v3", "gnu gpl v3", "gplv3", "gpl 3 0"),
    "lgpl-2.1": ("gnu lesser general public license version 2 1", "lgpl 2 1", "lgplv2 1"),
    "lgpl-3": ("gnu lesser general public license version 3", "lgpl 3 0", "lgplv3"),
    "agpl-3": ("gnu affero general public license version 3", "agpl 3 0", "agplv3"),
    "mpl-2": ("mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"),
    "epl-1": ("eclipse public license 1 0", "eclipse public license version 1 0", "epl 1 0"),
    "epl-2": ("eclipse public license 2 0", "eclipse public license version 2 0", "epl 2 0"),
    "bsd-2": ("bsd 2 clause", "2 clause bsd", "simplified bsd license"),
    "bsd-3": ("bsd 3 clause", "3 clause bsd", "new bsd license", "revised bsd license"),
    "bsd": ("bsd license", "bsd licence", "bsd style license"),
    "mpl-1.1": ("mozilla public license version 1 1", "mozilla public license 1 1", "mpl 1 1"),
    "artistic": ("artistic license 2 0", "perl artistic license", "the artistic license", "artistic license version"),
    "eupl": ("european union public licence", "eupl 1 2"),
    "cddl": ("common development and distribution license", "cddl 1 0"),
    "psf": ("python software foundation license", "psf license"),
    "cc-by-nc-sa": ("attribution noncommercial sharealike", "cc by nc sa"),
    "cc-by-nc-nd": ("attribution noncommercial noderivatives", "cc by nc nd"),
    "cc-by": ("cc by 4 0", "cc by 3 0"),
    "cc-by-sa": ("cc by sa",),
    "cc-by-nd": ("cc by nd",),
    "cc0": ("cc0 1 0", "cc0 universal", "cc0 public domain", "cc0 license", "under cc0"),
}
#: Labels of SPDX identifiers that give no name of the table above.
SPDX = {"MIT": "mit", "Apache-2.0": "apache-2", "ISC": "isc", "Unlicense": "unlicense", "Zlib": "zlib", "BSL-1.0": "boost", "OFL-1.1": "ofl", "WTFPL": "wtfpl", "CC-BY-NC-4.0": "cc-by-nc"}


#: An SPDX line and its expression, which ends with the line or a comment.
EXPRESSION = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n*#<>\"']{1,2000})", re.I)
OPERANDS = re.compile(r"[A-Za-z0-9.+-]+")


def expression_labels(text: str | None) -> set[str]:
    """The labels of all licenses of the SPDX expressions in a text, also of those after AND, OR and in parentheses; an exception after WITH is none."""
    out: set[str] = set()
    for m in EXPRESSION.finditer(text or ""):
        before = ""
        for x in OPERANDS.findall(m[1]):
            if before.upper() != "WITH" and x.upper() not in ("AND", "OR", "WITH"):
                label = IDENTIFIERS.get(re.sub(r"(?:-only|-or-later|\+)$", "", x, flags=re.I).lower())
                if label is None and (before or m[1].strip() != x) and before.upper() not in ("AND", "OR", ""):
                    break  # prose follows
                out |= families(label) if label else set()
            before = x
    return out


def templates() -> list[tuple[str, list[str], list[list[str]]]]:
    """Label, words and mandatory phrases of every notice, name and identifier; a version's name gives its family's label too."""
    out = [(label, text, must) for label, text, must in NOTICES]
    out += [(label, name, [name]) for label, names in NAMES.items() for name in names]
    for identifier, label in SPDX.items():
        text = " ".join(WORD.findall(f"spdx-license-identifier {identifier}".lower()))
        out.append((label, text, [text]))
    return [(label, text.split(), [m.split() for m in must]) for label, text, must in out]


def families(label: str) -> set[str]:
    """A label and, of a version of a license that has one, its family's."""
    head = label.split("-")[0]
    return {label, head} if head in ("gpl", "lgpl", "agpl", "bsd") else {label}


#: Labels of SPDX identifiers, in lower case.
IDENTIFIERS = {k.lower(): v for k, v in SPDX.items()} | {
    "gpl-2.0": "gpl-2", "gpl-3.0": "gpl-3", "lgpl-2.1": "lgpl-2.1", "lgpl-3.0": "lgpl-3", "agpl-3.0": "agpl-3", "mpl-1.1": "mpl-1.1", "mpl-2.0": "mpl-2", "epl-1.0": "epl-1", "epl-2.0": "epl-2", "bsd-2-clause": "bsd-2", "bsd-3-clause": "bsd-3",
    "artistic-2.0": "artistic", "eupl-1.2": "eupl", "cddl-1.0": "cddl", "psf-2.0": "psf", "cc0-1.0": "cc0", "cc-by-3.0": "cc-by", "cc-by-4.0": "cc-by", "cc-by-sa-4.0": "cc-by-sa", "cc-by-nd-4.0": "cc-by-nd", "cc-by-nc-sa-4.0": "cc-by-nc-sa", "cc-by-nc-nd-4.0": "cc-by-nc-nd",
}


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def places(words: list[str], phrase: list[str], at: dict[str, list[int]]) -> list[int]:
    n = len(phrase)
    rare = min(range(n), key=lambda j: len(at.get(phrase[j], ())))
    return [p - rare for p in at.get(phrase[rare], ()) if p >= rare and words[p - rare : p - rare + n] == phrase]


class Index:
    """Postings of the templates' words."""

    def __init__(self, df: dict[str, int], documents: int):
        self.phrases = [(p.split(), label) for p, label in BASE]
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.templates = templates()
        self.idf = {w: math.log((documents + 1) / (df.get(w, 0) + 1)) for _, ws, _ in self.templates for w in ws}
        for t, (_, ws, _) in enumerate(self.templates):
            for q, w in enumerate(ws):
                self.postings[w].append((t, q))
        self.seen = {*self.postings, *(w for p, _ in self.phrases for w in p)}

    def scan(self, words: list[str]) -> tuple[int, int | None, int | None, str, str, float]:
        at: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.seen:
                at[w].append(i)
        base, labels = [], set()
        for phrase, label in self.phrases:
            found = places(words, phrase, at)
            base += found
            labels |= {label} if found else set()
        held: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for w in sorted(at.keys() & self.postings.keys(), key=lambda w: (-self.idf[w], w)):
            for t, q in self.postings[w]:
                held[t].append((w, q))
        every, score = set(labels), float(bool(base))
        for t, own in held.items():
            label, template, must = self.templates[t]
            size = len(template)
            need = math.ceil(SHARE * size - 1e-9)
            if len(own) < need or not all(w in at for m in must for w in m):
                continue
            musts = [places(words, m, at) for m in must]
            if not all(musts):
                continue
            starts = {p - q for w, q in own[: len(own) - need + 1] for p in at[w]}
            starts = {x + d for x in starts for d in range(-SLACK, SLACK + 1)}
            got = sorted((p - q, q) for w, q in own for p in at[w] if p - q in starts)
            near = lambda ps, start, size=size: (k := bisect_left(ps, start - SLACK)) < len(ps) and ps[k] <= start + size + SLACK
            j, best = 0, 0
            inside: dict[int, int] = defaultdict(int)
            for start, q in got:  # a window that slides over the starts
                inside[q] += 1
                while got[j][0] < start - SLACK:
                    old = got[j][1]
                    inside[old] -= 1
                    if not inside[old]:
                        del inside[old]
                    j += 1
                if len(inside) > best and all(near(ps, start) for ps in musts):
                    best = len(inside)
            if best >= need:
                every |= families(label)
                score = max(score, min(1.0, best / size))
        return len(base), min(base, default=None), max(base, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), score


def template_df(docs: DataFrame) -> tuple[dict[str, int], int]:
    """In how many of all documents each template word stands, and how many documents there are."""
    vocabulary = sorted({w for _, ws, _ in templates() for w in ws})

    def run(batches):
        df, n, known = defaultdict(int), 0, set(vocabulary)
        for b in batches:
            for text in b.column("text").to_pylist():
                n += 1
                for w in known.intersection(words_of(text)):
                    df[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([*df, ""], pa.string()), pa.array([*df.values(), n], pa.int64())], ["word", "n"])

    counts = {r.word: r.n for r in docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row for each template word
    return counts, counts.pop("", 0)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text)."""
    tn.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    df, n = template_df(docs)

    def run(batches):
        index = Index(df, n)
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                words = words_of(text)
                found = index.scan(words)
                if more := expression_labels(text):
                    found = (*found[:4], ",".join(sorted({*filter(None, found[4].split(",")), *more})), 1.0)
                rows.append((len(words), *found))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
