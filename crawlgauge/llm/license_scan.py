"""Licence scan by a positional index of rare words.

TEMPLATES are notices of licences: short references and full texts. Their words are
indexed as postings, word to (template, position), and each mandatory phrase under its
rarest word, word to (phrase, position); how rare a word is follows from the documents in
which it occurs, over all documents. A document's licence words are looked up, rarest
first. The rarest words of a notice that the document holds propose alignments (place less
position), the notice's postings are intersected by relative position, and words that
stand at one alignment add up: a notice is proposed if SHARE of its rarity mass does. Each
place of a phrase's rarest word proposes a start of the phrase, and its other words must
stand at the same distance from it. A notice with one of its mandatory phrases in full
gives its label; one that is proposed without such a phrase, with words changed or left
out there, is named in ``unverified``. ``score`` is the best share of the notices that are
proposed or labelled; 0 without any. Short references (under LEAST_WORDS) are mostly phrase;
they are labelled wherever it stands and not proposed otherwise.

Edge cases: a null text is an empty one; it has no words, no labels and score 0. Texts of
any length are scanned whole, a batch of them at a time; of equally rare words the first
of the phrase or notice counts as rarest, which changes no label; repeated rows are
scanned each; other columns are carried along whatever their names; an empty table gives
an empty result. Words are compared after lower-casing A-Z only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, small_batches, table

#: A notice is proposed by its postings from this share of its rarity mass at one alignment.
SHARE = 0.5
#: Shorter notices are references: half of "licensed under cc by" proposes nothing, so only their phrases count.
LEAST_WORDS = 20
#: The base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: label, notice, mandatory phrases (any one of them, in full). First short references, then notices in full.
TEMPLATES = [
    ("cc-by", "licensed under cc by", ["cc by"]),
    ("cc-by-sa", "licensed under cc by sa", ["cc by sa"]),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", ["general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license", "library general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["affero general public license"]),
    ("reserved", "copyright all rights reserved", ["all rights reserved"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms", "bsd license"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc0", "dedicated to the public domain under the creative commons zero cc0", ["creative commons zero", "cc0 1 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
        Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
        and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.""",
        ["permission is hereby granted free of charge to any person obtaining a copy", "shall be included in all copies or substantial portions of the software"],
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
        this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE.""",
        ["isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee", "provided that the above copyright notice and this permission notice appear in all copies"],
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of
        source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of
        the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
        ["redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"],
    ),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        ["you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"],
    ),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
        either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        ["under the terms of the gnu general public license", "see the gnu general public license for more details"],
    ),
    (
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software
        Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.""",
        ["under the terms of the gnu lesser general public license", "under the terms of the gnu library general public license"],
    ),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0/.""",
        ["this source code form is subject to the terms of the mozilla public license", "if a copy of the mpl was not distributed with this file"],
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either
        in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        ["anyone is free to copy modify publish use compile sell or distribute this software", "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
        software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.""",
        ["zlib license", "permission is granted to anyone to use this software for any purpose including commercial applications", "in no event will the authors be held liable for any damages arising from the use of this software"],
    ),
    (
        "bsl-1.0",
        """Boost Software License, Version 1.0. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software.""",
        ["boost software license", "free of charge to any person or organization obtaining a copy of the software", "to use reproduce display distribute execute and transmit the software"],
    ),
    (
        "cc-by",
        """This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/.""",
        ["creative commons attribution 4 0", "creative commons attribution 3 0"],
    ),
    (
        "cc-by-sa",
        """This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit
        http://creativecommons.org/licenses/by-sa/4.0/.""",
        ["creative commons attribution sharealike"],
    ),
]
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, unverified string"

#: Bytes of UTF-8 text to word bytes: A-Z to a-z, ASCII that is no letter or digit to a space, all others kept.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class PositionalIndex:
    """Postings of the templates' words, and of phrases under their rarest word; small and fixed by TEMPLATES."""

    def __init__(self, templates=TEMPLATES, idf: dict[bytes, float] | None = None):
        self.labels = [label for label, _, _ in templates]
        notices = [words_of(notice) for _, notice, _ in templates]
        #: words, label and template (None: a base phrase) of each phrase
        self.phrases = [(words_of(p), label, None) for p, label in BASE_PHRASES.items()]
        self.phrases += [(words_of(p), label, t) for t, (label, _, phrases) in enumerate(templates) for p in phrases]
        self.vocabulary = {w for words in [*notices, *(p for p, _, _ in self.phrases)] for w in words}
        self.idf = idf = dict.fromkeys(self.vocabulary, 1.0) if idf is None else idf
        self.size = [len(notice) for notice in notices]
        self.mass = [sum(idf[w] for w in notice) for notice in notices]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, notice in enumerate(notices):
            for i, w in enumerate(notice):
                self.postings.setdefault(w, []).append((t, i))
        self.keys: dict[bytes, list[tuple[int, int]]] = {}
        for n, (words, _, _) in enumerate(self.phrases):
            at = max(range(len(words)), key=lambda i: (idf[words[i]], -i))
            self.keys.setdefault(words[at], []).append((n, at))

    def phrase_starts(self, words: list[bytes], places: dict[bytes, list[int]]) -> Iterator[tuple[int, int]]:
        """(phrase, start) of all phrases that stand in full, from the document's licence words, rarest first."""
        for w in sorted(places.keys() & self.keys.keys(), key=lambda w: (-self.idf[w], w)):
            for n, at in self.keys[w]:
                phrase = self.phrases[n][0]
                for p in places[w]:
                    if p >= at and words[p - at : p - at + len(phrase)] == phrase:
                        yield n, p - at

    def shares(self, named: set[int], places: dict[bytes, list[int]]) -> dict[int, float]:
        """Each proposed or named notice's best share of rarity mass at one alignment.

        A notice whose held words lack SHARE of its mass is left at once. Of the others the
        rarest words propose alignments (place less position), as many as it takes for the
        rest to weigh less than SHARE: so each alignment of that share is proposed. Postings
        then add up where they meet a proposed alignment.
        """
        held: dict[int, list[tuple[float, int, bytes]]] = {}
        for w in places.keys() & self.postings.keys():
            for t, i in self.postings[w]:
                if self.size[t] < LEAST_WORDS and t not in named:
                    continue
                held.setdefault(t, []).append((self.idf[w], i, w))
        out = {}
        for t, present in held.items():
            least = 0.0 if t in named else SHARE * self.mass[t] * (1 - 1e-9)
            left = sum(x[0] for x in present)
            if not self.mass[t] or left < least:
                continue
            mass: dict[int, float] = {}
            for idf, i, w in sorted(present, key=lambda x: (-x[0], x[1])):
                opens = left >= least
                left -= idf
                for p in places[w]:
                    if opens or p - i in mass:
                        mass[p - i] = mass.get(p - i, 0.0) + idf
            share = min(1.0, max(mass.values(), default=0.0) / self.mass[t])
            if t in named or share >= SHARE * (1 - 1e-9):
                out[t] = share
        return out

    def scan(self, text: str | None) -> tuple:
        """What stands in a text, without ``unverified``."""
        return self.judge(text)[:-1]

    def judge(self, text: str | None) -> tuple:
        """The SCHEMA columns of a text."""
        words = words_of(text)
        places: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.vocabulary:
                places.setdefault(w, []).append(i)
        starts, base_labels, labels, found = [], set(), set(), set()
        for n, start in self.phrase_starts(words, places):
            _, label, t = self.phrases[n]
            labels.add(label)
            if t is None:
                starts.append(start)
                base_labels.add(label)
            else:
                found.add(t)
        shares = self.shares(found, places)
        unverified = {self.labels[t] for t in shares} - labels
        return (
            len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base_labels)), ",".join(sorted(labels)), max(shares.values(), default=0.0), ",".join(sorted(unverified)),
        )


def rarity(docs: DataFrame, text: str = "text", templates=TEMPLATES) -> dict[bytes, float]:
    """Inverse document frequency of each licence word over all documents. At most as many rows as licence words reach the driver."""
    vocabulary = PositionalIndex(templates).vocabulary

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = dict.fromkeys(sorted(vocabulary), 0), 0
        for batch in batches:
            for t in batch.iloc[:, 0]:
                n += 1
                for w in vocabulary.intersection(words_of(t)):
                    seen[w] += 1
        yield pd.DataFrame({"word": ["", *[w.decode() for w in seen]], "docs": [n, *seen.values()]})

    counted = docs.select(F.col(text)).mapInPandas(frugal(count), "word string, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
    df = {r["word"]: r["docs"] for r in counted.collect()}  # bounded by the fixed vocabulary
    n = df.get("", 0)
    return {w: math.log((n + 1) / (df.get(w.decode(), 0) + 1)) + 1e-9 for w in vocabulary}


def scan(docs: DataFrame, text: str = "text", templates=TEMPLATES) -> DataFrame:
    """row (docs' columns) and the SCHEMA columns; n_base counts all places of BASE_PHRASES."""
    small_batches(docs.sparkSession)
    index = PositionalIndex(templates, rarity(docs, text, templates))
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def scan_all(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = pd.DataFrame([index.judge(t) for t in texts], columns=names)
            yield out.astype({"first_word": "Int64", "last_word": "Int64", "n_words": "int64", "n_base": "int64", "score": "float64"})

    found = F.pandas_udf(frugal(scan_all), SCHEMA)
    return docs.select(F.struct("*").alias("row")).withColumn("s", found(F.col(f"row.{text}"))).select("row", "s.*")


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return found.select("row.doc_id", *names[:-2], F.round("score", 6).alias("score"), "unverified")


def _rows(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows) + ")"


_NOTICES = [(t, label, i, w) for t, (label, notice, _) in enumerate(TEMPLATES) for i, w in enumerate(x.decode() for x in words_of(notice))]
_MANDATORY = [(t, t * 100 + n, len(p.split()), j, w) for t, (_, _, phrases) in enumerate(TEMPLATES) for n, p in enumerate(phrases) for j, w in enumerate(p.split())]
_BASE = [(n, label, len(p.split()), j, w) for n, (p, label) in enumerate(BASE_PHRASES.items()) for j, w in enumerate(p.split())]
SQL = rf"""
WITH {_rows("notice", "t, label, i, w", _NOTICES)}, {_rows("mandatory", "t, ph, len, j, w", _MANDATORY)}, {_rows("base", "ph, label, len, j, w", _BASE)},
vocabulary AS (SELECT w FROM notice UNION SELECT w FROM mandatory UNION SELECT w FROM base),
texts AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x01-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
places AS (SELECT k, unnest(range(0, len(words))) AS p, unnest(words) AS w FROM texts),
held AS (SELECT k, p, w FROM places SEMI JOIN vocabulary USING (w)),
rarity AS (
  SELECT w, ln(((SELECT count(*) FROM texts) + 1) / (count(DISTINCT k) + 1)) + 1e-9 AS idf FROM vocabulary LEFT JOIN held USING (w) GROUP BY w),
hits AS (SELECT k, ph, label, p - j AS s FROM held JOIN base USING (w) GROUP BY k, ph, label, p - j, len HAVING count(*) = len),
base_of AS (SELECT k, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, list_distinct(list(label)) AS labels FROM hits GROUP BY k),
named AS (SELECT DISTINCT k, t FROM (SELECT k, t FROM held JOIN mandatory USING (w) GROUP BY k, t, ph, p - j, len HAVING count(*) = len)),
totals AS (SELECT t, any_value(label) AS label, sum(idf) AS total, count(*) AS size FROM notice JOIN rarity USING (w) GROUP BY t),
mass AS (SELECT k, t, p - i AS s, sum(idf) AS m FROM held JOIN notice USING (w) JOIN rarity USING (w) GROUP BY k, t, p - i),
best AS (SELECT k, t, max(m) AS m FROM mass GROUP BY k, t),
shares AS (SELECT k, t, label, least(1.0, m / total) AS share FROM best JOIN totals USING (t) LEFT JOIN (SELECT k, t, true AS is_named FROM named) n USING (k, t) WHERE is_named OR size >= {LEAST_WORDS} AND m >= {SHARE} * total * (1 - 1e-9)),
scores AS (SELECT k, max(share) AS score FROM shares GROUP BY k),
labels_of AS (SELECT k, list_distinct(list(label)) AS labels FROM (SELECT k, label FROM named JOIN (SELECT DISTINCT t, label FROM notice) USING (t) UNION ALL SELECT k, label FROM hits) GROUP BY k),
unverified AS (SELECT k, list_sort(list_distinct(list(shares.label))) AS u FROM shares LEFT JOIN labels_of l USING (k) WHERE NOT coalesce(list_contains(l.labels, shares.label), false) GROUP BY k)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels, coalesce(array_to_string(list_sort(l.labels), ','), '') AS labels, round(coalesce(CAST(score AS DOUBLE), 0), 6) AS score,
       coalesce(array_to_string(u, ','), '') AS unverified
FROM texts LEFT JOIN base_of b USING (k) LEFT JOIN labels_of l USING (k) LEFT JOIN scores USING (k) LEFT JOIN unverified USING (k)
"""
