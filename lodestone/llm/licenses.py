"""License scan: exact containment join of text blocks with license templates, on DataFrame functions only.

A document's words are the runs of [0-9a-z] and non-ASCII characters after lower-casing A-Z. A template is a
set of words. A text block of a template is a window of its words, twice as long as the template (rounded up
to a power of two), from any word on. A block matches when it holds at least THRESHOLD of the template's words.
Moving a block's start on to its first template word loses none of them, so blocks that start at template words
stand for all.

The join is the usual exact one for set similarity. All template words are ordered by their frequency in the
whole corpus, rarest first (the table of counts has one row a template word, so it is small by construction). With `need` words to share, a matching block must hold one of the template's first
size - need + 1 words. An inverted index of these prefixes gives a document's candidate templates (prefix filter); `need`
distinct template words must stand in it (length filter), and `need` of them from a block's start on within its length
(positional filter); what passes is verified by counting distinct words.

Templates are any number of (label, text), up to MOST_WORDS different words together. Their index travels as arrays: a hash table
of the vocabulary, so that a document's word costs one look-up however many templates there are, the prefix index, and
each template's words. A document is joined with it in its own row: no row is shuffled, and long or hot groups cannot pile up.
Texts are read once; the places of template words, which the counts and the join both need, are written to the shared folder.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, whole

#: Characters that part words, as a regular expression class for text of either case.
GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases and labels of the base scan.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# The templates of the method, (label, words).
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved-notice", "copyright all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

# Longer templates, (label, text) of whole notices and license texts.
LONG_TEMPLATES = (
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is "
        "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or "
        "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for "
        "any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or "
        "in connection with the use or performance of this software",
    ),
    (
        "bsd-2-clause-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
        "materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of "
        "merchantability and fitness for a particular purpose are disclaimed",
    ),
    (
        "zlib-text",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this "
        "software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim "
        "that you wrote the original software altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
    ),
    (
        "apache-2.0-notice",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required "
        "by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific "
        "language governing permissions and limitations under the license",
    ),
    (
        "gpl-3-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any "
        "later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public "
        "license for more details you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses",
    ),
    (
        "unlicense-text",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose "
        "commercial or non commercial and by any means",
    ),
    (
        "boost-text",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and "
        "transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so",
    ),
)

THRESHOLD = 0.9
#: Most different words of all templates; the index then is a few MB.
MOST_WORDS = 1 << 16


def block_size(words: int) -> int:
    return max(8, 1 << math.ceil(math.log2(2 * words)))


def needed(distinct: int, threshold: float = THRESHOLD) -> int:
    return math.ceil(round(threshold * distinct, 9))


def _array(values: list, kind: str = "int") -> Column:
    """A constant array, as an expression that the optimizer folds, however long it is."""
    return F.split(F.lit(",".join(map(str, values))), ",", -1).cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def _lists(values: list[list[int]]):
    """A function that gives the list of a number, over constant arrays of all lists' values, starts and lengths."""
    flat, starts, sizes = _array([x for v in values for x in v]), _array([1 + sum(map(len, values[:k])) for k in range(len(values))]), _array([len(v) for v in values])
    return lambda k: F.slice(flat, F.get(starts, k), F.get(sizes, k))


class Vocabulary:
    """Words by number, from 1, and a hash table of them in arrays: tables of slots that hold a word's number or 0.

    A word stands in the first table, or, if another has its slot there, in the next one, by another hash.
    """

    def __init__(self, spark: SparkSession, words: list[str]):
        if len(words) > MOST_WORDS:
            raise ValueError(f"the templates have {len(words)} different words, more than {MOST_WORDS}")
        self.words = words
        self.slots = 1 << max(4, (8 * len(words)).bit_length())
        self.tables: list[list[int]] = []
        left = list(enumerate(words, 1))
        while left and len(self.tables) < 8:
            at = spark.createDataFrame([(i, w) for i, w in left], "i int, w string").select("i", self.slot(F.col("w"), len(self.tables)).alias("slot"))
            table, rest = [0] * self.slots, []
            for r in sorted(at.collect()):
                if table[r.slot]:
                    rest.append((r.i, words[r.i - 1]))
                else:
                    table[r.slot] = r.i
            self.tables.append(table)
            left = rest
        if left:
            raise ValueError("the vocabulary does not fit its tables")

    def slot(self, w: Column, k: int) -> Column:
        return F.xxhash64(w, F.lit(k)).bitwiseAND(self.slots - 1).cast("int")

    def number(self, w: Column) -> Column:
        """The word's number; 0 for words outside. A free slot of a table ends the search."""
        words, out = _array(["", *self.words], "string"), F.lit(0)
        for k in reversed(range(len(self.tables))):
            held = F.get(_array(self.tables[k]), self.slot(w, k))
            out = F.when(held == 0, F.lit(0)).when(F.get(words, held) == w, held).otherwise(out)
        return out


def words_of(text: Column) -> Column:
    """The words of a text, lowered, in order."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), rf"[{GAP}]+"), lambda w: w != "")


def hits_of(words: Column, vocabulary: Vocabulary) -> Column:
    """The words of the vocabulary among words, in order, as (i, r): place and number."""
    at = F.transform(words, lambda w, i: F.struct(i.alias("i"), vocabulary.number(w).alias("r")))
    return F.filter(at, lambda h: h["r"] > 0)


def _best(hits: Column, ranks: Column, length: Column, need: Column) -> Column:
    """The most distinct words of a template in a block, if that is `need` or more, else 0. hits are in order."""
    held = F.filter(hits, lambda h: F.array_contains(ranks, h["r"]))

    def of(held: Column) -> Column:
        def distinct(x: Column, k: Column) -> Column:
            block = F.filter(F.slice(held, k + 1, length), lambda y: y["i"] < x["i"] + length)
            return F.when(F.get(held, k + need - 1)["i"] < x["i"] + length, F.size(F.array_distinct(F.transform(block, lambda y: y["r"]))))

        enough = F.size(F.array_distinct(F.transform(held, lambda y: y["r"]))) >= need
        return F.when(enough, F.coalesce(F.array_max(F.transform(held, distinct)), F.lit(0))).otherwise(0)

    # the filtered array is made once: it is the element of an array of one
    found = F.get(F.transform(F.array(held), of), F.lit(0))
    return F.when(found >= need, found).otherwise(0)


def _places(hits: Column, phrase: list[int]) -> Column:
    """Where the words of a phrase, by number, stand consecutively: every word of a phrase is in the vocabulary, so in hits."""

    def here(h: Column, k: Column) -> Column:
        hit = h["r"] == phrase[0]
        for j, r in enumerate(phrase[1:], 1):
            then = F.get(hits, k + j)
            hit = hit & (then["r"] == r) & (then["i"] == h["i"] + j)
        return F.when(hit, h["i"].cast("long"))

    return F.filter(F.transform(hits, here), lambda i: i.isNotNull())


def scan(docs: DataFrame, templates=TEMPLATES + LONG_TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row for each row of docs.

    score is the largest containment of a matched template, 1 where a base phrase stands, else 0. A null or
    empty text has no words, no labels, null first_word and last_word and score 0. Repeated rows are scanned
    one by one; an empty table gives an empty result; other columns of docs are not read. templates are pairs of a label
    and its words, parted by blanks; a label may have several.
    """
    sets = [(label, sorted(set(words.split())), block_size(len(words.split()))) for label, words in templates if words.split()]
    known = Vocabulary(docs.sparkSession, sorted({w for _, s, _ in sets for w in s} | {w for p, _ in BASE for w in p.split(" ")}))
    number = {w: i for i, w in enumerate(known.words, 1)}
    rows = docs.select("doc_id", whole().alias("text")).withColumn("words", words_of(F.col("text")))
    # texts are read once: what is left of them is the places of template words
    rows = staged(rows.select("doc_id", F.size("words").cast("long").alias("n_words"), hits_of(F.col("words"), known).alias("hits")), "licenses")
    counts = {r["r"]: r["count"] for r in rows.select(F.explode("hits").alias("h")).groupBy("h.r").count().collect()}  # a row a template word
    rank = sorted(range(1, len(known.words) + 1), key=lambda r: (counts.get(r, 0), known.words[r - 1]))
    place = {r: k for k, r in enumerate(rank)}
    ranks = [sorted((number[w] for w in s), key=place.__getitem__) for _, s, _ in sets]
    need = [needed(len(s), threshold) for _, s, _ in sets]
    prefixes: list[list[int]] = [[] for _ in range(len(known.words) + 1)]
    for t, (r, k) in enumerate(zip(ranks, need, strict=True)):
        for x in r[: len(r) - k + 1]:
            prefixes[x].append(t)

    present = F.array_distinct(F.transform("hits", lambda h: h["r"]))
    prefix_of, ranks_of, labels = _lists(prefixes), _lists(ranks), _array([label for label, *_ in sets], "string")
    asked = F.array_distinct(F.flatten(F.transform(present, prefix_of)))
    rows = rows.withColumn("asked", F.when(F.size("hits") > 0, asked).otherwise(F.array().cast("array<int>")))
    lengths, sizes = [n for *_, n in sets], [len(s) for _, s, _ in sets]
    at = lambda values, t: F.get(_array(values), t)
    hits = F.col("hits")
    most = lambda t: _best(hits, ranks_of(t), at(lengths, t), at(need, t))
    fits = F.filter(F.transform("asked", lambda t: F.struct(t.alias("t"), (most(t) / at(sizes, t)).alias("fit"))), lambda f: f["fit"] > 0)
    rows = rows.withColumns({"fits": fits} | {f"base{k}": _places(hits, [number[w] for w in p.split(" ")]) for k, (p, _) in enumerate(BASE)})
    places = F.flatten(F.array(*[F.col(f"base{k}") for k in range(len(BASE))]))
    base = F.array_compact(F.array(*[F.when(F.size(f"base{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]))
    more = F.transform("fits", lambda f: F.get(labels, f["t"]))
    best = F.greatest(F.when(F.size(places) > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("fits", lambda f: f["fit"])), F.lit(0.0)))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.round(best, 6).alias("score"),
    )


def scan_sql(templates=TEMPLATES + LONG_TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same rows in DuckDB by plain counting in the block from every template word on, without the filters."""
    tokens = ", ".join(
        f"({t}, '{label}', '{w}', {block_size(len(words.split()))}, {len(set(words.split()))}, {needed(len(set(words.split())), threshold)})" for t, (label, words) in enumerate(templates) for w in sorted(set(words.split()))
    )
    base = " UNION ALL ".join(
        f"SELECT a.doc_id, a.i, '{label}' AS label FROM w a " + " ".join(f"JOIN w b{k} ON b{k}.doc_id = a.doc_id AND b{k}.i = a.i + {k} AND b{k}.w = '{x}'" for k, x in enumerate(p.split(" ")) if k) + f" WHERE a.w = '{p.split(' ')[0]}'"
        for p, label in BASE
    )
    return rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[{GAP}]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM d),
p AS ({base}),
t(t, label, w, length, size, need) AS (VALUES {tokens}),
h AS (SELECT doc_id, t, label, w.w, i, length, size, need FROM w JOIN t ON t.w = w.w),
k AS (SELECT doc_id, t FROM h GROUP BY doc_id, t HAVING count(DISTINCT w) >= any_value(need)),
x AS (SELECT h.* FROM h JOIN k USING (doc_id, t)),
m AS (SELECT x.doc_id, x.label, count(DISTINCT y.w) * 1.0::DOUBLE / any_value(x.size) AS fit FROM x JOIN x y ON y.doc_id = x.doc_id AND y.t = x.t AND y.i BETWEEN x.i AND x.i + x.length - 1 GROUP BY x.doc_id, x.label, x.t, x.i HAVING count(DISTINCT y.w) >= any_value(x.need)),
l AS (SELECT doc_id, label, true AS base, 1.0::DOUBLE AS fit FROM p UNION ALL SELECT doc_id, label, false, fit FROM m),
g AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(fit) AS fit FROM l GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(q.n, 0) AS BIGINT) AS n_base, CAST(q.a AS BIGINT) AS first_word, CAST(q.z AS BIGINT) AS last_word,
       coalesce(q.labels, '') AS base_labels, coalesce(g.labels, '') AS labels, round(coalesce(g.fit, 0.0), 6)::DOUBLE AS score
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN q USING (doc_id)
"""
