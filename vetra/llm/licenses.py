"""Licence scans with a positional index of rare words.

Templates are licence notices and whole licence texts. Their words' document frequencies over the whole corpus give each word
a weight (idf). For each file, the words of highest idf that any template has are looked up in the
templates' postings; a hit at file position p and template position t votes for the template to start
at p - t, and votes at (nearly) one place are intersected. Where enough of a template's rare weight
stands in place, the alignment is measured over all its words and the template's mandatory key phrases
are verified word by word. Fixed base phrases are counted exactly beside that.
"""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Label, words of the notice or text, key phrases that must all stand in it.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license", "version 2"]),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["in compliance with the license", "apache org licenses license 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-3", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ["gnu general public license", "version 3 of the license"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ["permission is hereby granted free of charge", "copies or substantial portions of the software"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", ["for any purpose with or without fee"]),
    ("bsd-2", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", ["redistributions of source code must retain", "redistributions in binary form must reproduce"]),
    ("bsd-3", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["neither the name of the copyright holder", "endorse or promote products derived from this software"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ["to alter it and redistribute it freely"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain", ["free and unencumbered software", "dedicate any and all copyright interest"]),
]

#: Bytes to words: A-Z lower-cased, ASCII other than letters and digits to spaces.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(TABLE).split()


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("raw"))


def document_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many documents each word of ``vocabulary`` stands, and the number of documents."""

    def run(batches):
        total, found = 0, dict.fromkeys(vocabulary, 0)
        for batch in batches:
            total += batch.num_rows
            for raw in batch.column(1):
                for w in vocabulary.intersection(words_of(raw.as_py())):
                    found[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([None, *found], pa.binary()), pa.array([total, *found.values()], pa.int64())], names=["word", "n"])

    rows = _texts(docs).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # as many as the templates' words
    counts = {None if r["word"] is None else bytes(r["word"]): r["n"] for r in rows}
    return {w: counts.get(w, 0) for w in vocabulary}, counts.get(None, 0)


class Index:
    """Postings of the templates' words, each with its idf."""

    def __init__(self, templates, frequency: dict[bytes, int], total: int, rarest: int = 6) -> None:
        self.templates = [(label, text.encode().split(), [p.encode().split() for p in phrases]) for label, text, phrases in templates]
        self.idf = {w: log((total + 1) / (n + 1)) + 1e-6 for w, n in frequency.items()}
        self.anchors, self.weight, self.own_rare = set(), [], []
        self.longest = max((len(words) for _, words, _ in self.templates), default=0)
        for t, (_, words, _) in enumerate(self.templates):
            rare = sorted(set(words), key=lambda w: (-self.idf[w], w))[:rarest]
            self.anchors.add(rare[0])
            self.weight.append(sum(self.idf[w] for w in rare))
            self.own_rare.append({w: [i for i, x in enumerate(words) if x == w] for w in rare})  # the postings of this template
        self.rare = frozenset(w for own in self.own_rare for w in own)

    def match(self, words: list[bytes], slack: int = 2, enough: float = 0.6, chunk: int = 100_000) -> dict[str, float]:
        """label -> share of the best template's words that stand in place.

        ``words`` are gone through in overlapping parts of about ``chunk``, so a long file takes no more memory.
        """
        present = self.rare.intersection(words)
        if not present & self.anchors and sum(self.idf[w] for w in present) < enough * min(self.weight):
            return {}
        found: dict[str, float] = {}
        for at in range(0, len(words), chunk):
            lo = max(0, at - self.longest - slack)
            places: dict[bytes, list[int]] = {}
            for p, w in enumerate(words[lo : at + chunk + self.longest + slack], lo):
                if w in present:
                    places.setdefault(w, []).append(p)
            if places:
                self._aligned(words, {w: np.array(p) for w, p in places.items()}, slack, enough, found)
        return found

    def _aligned(self, words: list[bytes], places: dict[bytes, np.ndarray], slack: int, enough: float, found: dict[str, float]) -> None:
        for t, (label, own, phrases) in enumerate(self.templates):
            rare = [w for w in self.own_rare[t] if w in places]
            if sum(self.idf[w] for w in rare) < enough * self.weight[t] - 1e-9 or found.get(label, 0) >= 1:
                continue
            # where each word lets the template start; a start counts for all words that allow it within the slack
            starts = [np.unique(np.concatenate([places[w] - i for i in self.own_rare[t][w]])) for w in rare]
            wanted = np.unique(np.concatenate(starts)[:, None] + np.arange(-slack, slack + 1))
            votes = sum(self.idf[w] * (np.searchsorted(s, wanted + slack, "right") > np.searchsorted(s, wanted - slack)) for w, s in zip(rare, starts))
            for start in wanted[votes >= enough * self.weight[t] - 1e-9].tolist():
                in_place = sum(w in words[max(0, start + i - slack) : max(0, start + i + slack + 1)] for i, w in enumerate(own)) / len(own)
                if in_place >= enough and in_place > found.get(label, 0):
                    region = words[max(0, start - slack) : start + len(own) + slack]
                    if all(any(region[i : i + len(p)] == p for i in range(len(region))) for p in phrases):
                        found[label] = in_place
                        if in_place >= 1:
                            break


def base_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand consecutively."""
    joined, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases.items():
        wanted = f" {phrase} ".encode()
        at, last, nth = joined.find(wanted), 0, 0
        while at >= 0:
            nth += joined.count(b" ", last, at)  # words between one place and the next
            last = at
            out.append((nth, label))
            at = joined.find(wanted, at + 1)
    return out


def license_scan(docs: DataFrame, templates=None, base: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every whole text.

    Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased. A null
    text has no words; without a base phrase first_word and last_word are null; without a label the
    label lists are empty and the score is 0. A base label has score 1. A text of any length is scanned whole, in parts. Repeated rows are repeated, an
    empty table gives an empty result, other columns are ignored.
    """
    templates, base = templates or TEMPLATES, base or BASE
    vocabulary = {w for _, text, _ in templates for w in text.encode().split()}
    index = Index(templates, *document_frequencies(docs, vocabulary))

    def run(batches):
        for batch in batches:
            out = []
            for raw in batch.column(1):
                words = words_of(raw.as_py())
                places = base_places(words, base)
                own = {label for _, label in places}
                found = index.match(words)
                starts = [p for p, _ in places]
                score = 1.0 if own else max(found.values(), default=0.0)
                out.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | found.keys())), score))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
