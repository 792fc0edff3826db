"""License scan with a positional rare-token index.

Templates are names and sentences of licences. A file's licence words are looked up from the highest inverse document
frequency down; each has postings in the templates of which a mandatory phrase has it as its rarest word, and each of its
places in the file proposes the start of such a template. The template's other words are then looked up by their position
relative to that start, their inverse document frequencies added up, and a proposal counts if enough of them agree and one
of the template's mandatory phrases stands word for word at its place. Document frequencies are those of all files scanned;
a phrase holds its own rarest word, so no place of a phrase can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import words
from .workers import in_arrow, parts


@dataclass(frozen=True)
class Template:
    """``keys``: phrases of ``text`` of which one must stand there; none: the text itself. ``share`` of its IDF must agree."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    share: float = 1.0
    base: bool = False


#: fixed values: the phrases of the contract
BASE = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
)
#: fixed values: names of public licences
NAMES = (
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl", "mozilla public license"),
    Template("epl", "eclipse public license"),
    Template("bsd", "bsd license"),
    Template("isc", "isc license"),
    Template("zlib", "zlib license"),
    Template("boost", "boost software license"),
    Template("artistic", "artistic license"),
    Template("cc0", "cc0 1 0 universal"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-sa", "cc by sa"),
)
#: fixed values: sentences of public licences, each with the phrases of which one must stand in it word for word; a sentence
#: is a template of its own, so that words put in or left out elsewhere don't shift it
BODIES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge", "any person obtaining a copy of this software"), 0.7),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("shall be included in all copies or substantial portions of the software",), 0.7),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",), 0.7),
    Template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("must reproduce the above copyright notice this list of conditions",), 0.7),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("may be used to endorse or promote products derived from this software",), 0.6),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee is hereby granted",), 0.7),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("you may not use this file except in compliance with the license",), 0.7),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("software distributed under the license is distributed on an as is basis",), 0.7),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("under the terms of the gnu general public license as published by the free software foundation",), 0.7),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("under the terms of the gnu lesser general public license as published by the free software foundation",), 0.7),
    Template("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("under the terms of the gnu affero general public license as published by the free software foundation",), 0.7),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("this source code form is subject to the terms of the mozilla public license",), 0.7),
    Template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("made available under the terms of the eclipse public license",), 0.7),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",), 0.7),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable for any damages arising from the use of this software",), 0.7),
    Template("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization obtaining a copy of the software",), 0.7),
    Template("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ("changing it is allowed as long as the name is changed",), 0.7),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("licensed under a creative commons attribution 4 0 international license",), 0.7),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("licensed under a creative commons attribution sharealike 4 0 international license",), 0.7),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("licensed under a creative commons attribution noncommercial 4 0 international license",), 0.7),
)
MORE = (*NAMES, *BODIES)
TEMPLATES = (*BASE, *MORE)


class Index:
    """Postings of the templates' words; ``idf`` gives a word's weight."""

    def __init__(self, templates: tuple[Template, ...], idf: dict[bytes, float]):
        self.templates = templates
        self.words = [words(t.text.encode()) for t in templates]
        self.idf = idf
        self.vocabulary = {w for ws in self.words for w in ws}
        self.total = [sum(idf[w] for w in ws) for ws in self.words]
        self.keys = []
        self.anchors: dict[bytes, list[tuple[int, int]]] = {}
        for t, (template, ws) in enumerate(zip(templates, self.words)):
            phrases = [words(k.encode()) for k in template.keys] or [ws]
            places = []
            for phrase in phrases:
                starts = [i for i in range(len(ws) - len(phrase) + 1) if ws[i : i + len(phrase)] == phrase]
                if not phrase or not starts:
                    raise ValueError(f"{template.label}: a key phrase isn't in the template")
                places += [(i, phrase) for i in starts]
                # the rarest word of each phrase proposes the places where it can stand
                k = max(range(len(phrase)), key=lambda k: (idf[phrase[k]], -k))
                for i in starts:
                    if (t, i + k) not in self.anchors.setdefault(phrase[k], []):
                        self.anchors[phrase[k]].append((t, i + k))
            self.keys.append(places)

    def find(self, tokens: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, share of the template's IDF that agrees), by start; a start before the text is negative."""
        known = self.vocabulary
        if known.isdisjoint(tokens):
            return []
        postings: dict[bytes, list[int]] = {}
        for i, w in enumerate(tokens):
            if w in known:
                postings.setdefault(w, []).append(i)
        proposed: set[tuple[int, int]] = set()
        for w in sorted(postings, key=lambda w: -self.idf[w]):
            for t, at in self.anchors.get(w, ()):
                proposed.update((t, i - at) for i in postings[w])
        n, out = len(tokens), []
        for t, start in proposed:
            ws = self.words[t]
            if not any(0 <= start + i and tokens[start + i : start + i + len(p)] == p for i, p in self.keys[t]):
                continue
            agree = sum(self.idf[w] for k, w in enumerate(ws) if 0 <= start + k < n and tokens[start + k] == w)
            share = min(1.0, agree / self.total[t])
            if share >= self.templates[t].share - 1e-9:
                out.append((t, start, share))
        return sorted(out, key=lambda x: (x[1], x[0]))


def frequencies(docs: DataFrame, templates: tuple[Template, ...]) -> tuple[int, dict[bytes, int]]:
    """(documents, documents that hold each word of the templates), over all rows; as many numbers as templates have words."""
    vocabulary = sorted({w for t in templates for w in words(t.text.encode())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, count = set(vocabulary), 0, dict.fromkeys(vocabulary, 0)
        for b in batches:
            for text in b.column(0):
                n += 1
                for w in known.intersection(words(text.as_py())):
                    count[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([b"", *vocabulary], pa.binary()), pa.array([n, *(count[w] for w in vocabulary)], pa.int64())], names=["word", "n"])

    got = in_arrow(docs.select(F.encode(F.col("text").cast("string"), "UTF-8").alias("text")), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r["word"]): r["n"] for r in got}
    return found.pop(b"", 0), {w: found.get(w, 0) for w in vocabulary}


def scanned(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) for each row of ``docs``.

    A null or empty text has no words and no matches: counts 0, places null, labels empty, score 0. Matches are (label,
    start, score), by start and then by template. Repeated rows are scanned as often as they occur; null ids stay null; other
    columns are ignored; an empty table gives no rows; a very long text is one list of words at a time.
    """
    n, df = frequencies(docs, templates)
    idf = {w: log((n + 1) / (c + 1)) + 1 for w, c in df.items()}
    index = Index(templates, idf)
    match = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("score", pa.float64())]))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), match]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                tokens = words(text.as_py())
                found = index.find(tokens)
                base = [s for t, s, _ in found if templates[t].base]
                own = {templates[t].label for t, _, _ in found if templates[t].base}
                rows.append((
                    doc_id, len(tokens), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(own)),
                    ",".join(sorted({templates[t].label for t, _, _ in found})), max((x for _, _, x in found), default=0.0),
                    [{"label": templates[t].label, "start": s, "score": x} for t, s, x in found],
                ))
            cols = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    kind = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start:bigint,score:double>>"
    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text")), run, kind)
