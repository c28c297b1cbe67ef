"""Benchmark decontamination by latent semantic retrieval, with exact checks of what it finds.

Words are compared without punctuation, wherever it stands in them, and without case, in all scripts.

1. Document frequencies: passages of BLOCK * 2 words of every text are counted for each of the benchmark's words.
2. Distributed randomised SVD: A holds the TF-IDF weights of every passage, and of every benchmark item, over
   the benchmark's terms (words outside it have no weight in any item; words in more than MAX_DF of the
   passages are stop words of the model, and weigh in the checks only). Each task adds up A'(A Omega) for a Gaussian
   Omega over its passages; the sum is a sketch of A'A, from which the leading right singular vectors follow (Nystroem).
3. Candidates: passages, one starting at every block, and items are projected and compared by cosine, all
   passages against all items, one batch of texts at a time. As an item shorter than a passage fills only a
   part of it, the cosine it must reach shrinks with the root of that part.
4. Checks: enough of the item's words must stand near the passage at all; then some stretch little longer than
   the item must share a longest common subsequence of at least LCS_SHARE of it, so changed, dropped and added
   words are forgiven; then enough of the item's answer must be there: its rarest words.

Sums travel in blocks of fixed number and are added up in two steps, so each task sends the size of a sketch, whatever it
read, and no task gathers the parts of all others. The benchmark is a stated query set, taken in order in blocks of at most
MAX_WORDS words: a block's items are collected, and its model, whose terms are no more, goes to every task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import prepared
from .hashing import U, Words, batches, words_of

#: Words of a block; two blocks make a passage.
BLOCK = 24
MAX_DF = 0.02
#: Words of the items that are searched at once, if a single item has no more.
MAX_WORDS = 1 << 15
RANK, OVERSAMPLING = 96, 16
COSINE = 0.35
LCS_SHARE = 0.65
#: Items with fewer words must be there word by word.
SHORT = 8
ANSWER_WORDS, ANSWER_SHARE = 5, 0.4
#: Blocks in which sums travel, and groups of tasks that are added up first.
PIECES, GROUPS = 128, 256
#: In a table of terms, the mark of a slot that several have.
SEVERAL = -2

_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: UTF-8 of general punctuation: spaces and dashes part words, the rest goes; so do the angle quotes.
_SPACES, _PUNCTUATION = re.compile(rb"\xe2\x80[\x80-\x95\xa8\xa9\xaf]|\xc2\xa0"), re.compile(rb"\xe2\x80[\x96-\xbf]|\xc2[\xab\xbb\xa1\xbf]|\xe3\x80[\x81\x82]")


def bare_words(texts: list[bytes]) -> Words:
    """The words of lowered texts without punctuation."""
    out = []
    for t in texts:
        t = t.translate(None, _MARKS)
        if not t.isascii():
            t = _PUNCTUATION.sub(b"", _SPACES.sub(b" ", t))
        out.append(t)
    return words_of(out)


def _blocks_of(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block of each word, text of each block, first word of each block and one past the last)."""
    place = np.arange(len(w.text)) - w.first[w.text] if len(w.text) else np.empty(0, np.int64)
    new = place % BLOCK == 0
    start = np.flatnonzero(new)
    return np.cumsum(new) - 1, w.text[start], np.append(start, len(w.text))


def _sums(values: np.ndarray, task: int, pieces: int = PIECES) -> Iterator[pa.RecordBatch]:
    """Rows of values in pieces, as float32 bytes."""
    for i, x in enumerate(np.array_split(values, pieces)):
        yield pa.record_batch([pa.array([i], pa.int32()), pa.array([task % GROUPS], pa.int32()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], names=["piece", "of", "part"])


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in table["part"])
    return pa.table({"piece": table["piece"].slice(0, 1), "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _gathered(parts: DataFrame) -> np.ndarray:
    """Add the tasks' pieces up, first within GROUPS groups of tasks; what comes to the driver is one sum."""
    some = parts.groupBy("piece", "of").applyInArrow(_added, "piece int, part binary")
    rows = some.groupBy("piece").applyInArrow(_added, "piece int, part binary").collect()
    return np.concatenate([np.frombuffer(r["part"], np.float32) for r in sorted(rows, key=lambda r: r["piece"])] or [np.empty(0, np.float32)]).astype(np.float64)


def _task() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def _frequencies(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Terms = shared.value
        df = np.zeros(len(known.hash) + 1)
        for batch in it:
            for _, texts in batches(batch.column(0).to_pylist()):
                w = bare_words(texts)
                block, text, _ = _blocks_of(w)
                if len(text):
                    # passages are pairs of blocks from a text's first on
                    first = np.searchsorted(text, text)
                    passage = (np.arange(len(text)) - first) // 2 + first
                    number = known.of(w.hash)
                    live = np.flatnonzero(number >= 0)
                    seen = np.unique(passage[block[live]] << 32 | number[live])
                    df[:-1] += np.bincount(seen & 0xFFFFFFFF, minlength=len(known.hash))
                    df[-1] += len(np.unique(passage))
        yield from _sums(df, _task())

    return run


class Terms:
    """The items' terms by hash, their slot in the term space (-1: too frequent) and their idf, by the passages df that hold them."""

    def __init__(self, items: list[np.ndarray], df: np.ndarray | None = None):
        self.hash = np.unique(np.concatenate(items)) if items else np.empty(0, U)
        self.table: np.ndarray | None = None
        df = np.zeros(len(self.hash) + 1) if df is None else df.copy()
        for x in items:  # every item is a passage too
            df[np.searchsorted(self.hash, np.unique(x))] += 1
            df[-1] += 1
        n = max(1.0, df[-1])
        of = np.maximum(1.0, df[:-1])
        self.idf = np.log(1 + n / of)
        rare = of <= max(2.0, MAX_DF * n)
        self.slot = np.where(rare, np.cumsum(rare) - 1, -1)
        self.size = int(rare.sum())

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word among the terms, -1 for other words.

        A table by the leading bits of the hash has the only term there, or the mark of several, which are searched for.
        """
        if not len(self.hash):
            return np.full(len(hashes), -1)
        if self.table is None:
            self.bits = max(10, (16 * len(self.hash)).bit_length())
            slot = (self.hash >> U(64 - self.bits)).astype(np.int64)
            self.table = np.full(1 << self.bits, -1, np.int32)
            self.table[slot] = np.arange(len(slot))
            again = slot[1:] == slot[:-1]
            self.table[slot[1:][again]] = SEVERAL
        at = self.table[(hashes >> U(64 - self.bits)).astype(np.int64)]
        out = np.full(len(hashes), -1, np.int64)
        one = np.flatnonzero(at >= 0)
        one = one[self.hash[at[one]] == hashes[one]]
        out[one] = at[one]
        more = np.flatnonzero(at == SEVERAL)
        if len(more):
            spot = np.minimum(np.searchsorted(self.hash, hashes[more]), len(self.hash) - 1)
            hit = self.hash[spot] == hashes[more]
            out[more[hit]] = spot[hit]
        return out


def _entries(terms: Terms, number: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, slot, weight) of the words that have a weight, by group."""
    live = np.flatnonzero(number >= 0)
    live = live[terms.slot[number[live]] >= 0]
    return group[live], terms.slot[number[live]], terms.idf[number[live]].astype(np.float32)


def _grouped(groups: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sum of rows by group; groups ascend."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(groups):
        start = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
        out[groups[start]] = np.add.reduceat(rows, start, axis=0)
    return out


def _omega(size: int, width: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((size, width), np.float32)


def _sketched(model, width: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: Terms = model.value
        omega = _omega(terms.size, width)
        sketch = np.zeros((terms.size, width), np.float32)
        for batch in it:
            for _, texts in batches(batch.column(0).to_pylist()):
                w = bare_words(texts)
                block, text, _ = _blocks_of(w)
                first = np.searchsorted(text, text)
                passage = (np.arange(len(text)) - first) // 2 + first
                add_sketch(sketch, omega, *_entries(terms, terms.of(w.hash), passage[block] if len(text) else block))
        yield from _sums(sketch, _task())

    return run


def add_sketch(sketch: np.ndarray, omega: np.ndarray, row: np.ndarray, slot: np.ndarray, weight: np.ndarray) -> None:
    """Add A'(A omega) of these entries of A to the sketch; rows ascend."""
    if not len(row):
        return
    _, row = np.unique(row, return_inverse=True)
    y = _grouped(row, omega[slot] * weight[:, None], int(row[-1]) + 1)
    by = np.argsort(slot, kind="stable")
    start = np.flatnonzero(np.append(True, slot[by][1:] != slot[by][:-1]))
    sketch[slot[by][start]] += np.add.reduceat(y[row[by]] * weight[by][:, None], start, axis=0)


def singular_vectors(sketch: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors of A, a column each, from the sketch A'A omega."""
    if not len(sketch):
        return np.zeros((0, 0), np.float32)
    shift = 1e-7 * max(1e-30, float(np.linalg.norm(sketch)))
    shifted = sketch + shift * omega
    core = omega.T.astype(np.float64) @ shifted
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-10
    half = shifted @ (vectors[:, good] / np.sqrt(values[good]))
    left, _, _ = np.linalg.svd(half, full_matrices=False)
    return left[:, : min(rank, left.shape[1])].astype(np.float32)


def lcs(item: list[int], stretch: list[int], masks: dict[int, int]) -> int:
    """Length of the longest common subsequence; masks has the places of each word in the item, as bits."""
    full = (1 << len(item)) - 1
    v = full
    for x in stretch:
        m = masks.get(x)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(item) - v.bit_count()


class Index:
    """The items with their projections, what the checks need, and the search over a batch of texts."""

    def __init__(self, ids: list, items: list[np.ndarray], terms: Terms, basis: np.ndarray):
        self.ids, self.terms, self.basis = ids, terms, basis
        self.words = [x.tolist() for x in items]
        self.masks = []
        for words in self.words:
            m: dict[int, int] = {}
            for i, x in enumerate(words):
                m[x] = m.get(x, 0) | 1 << i
            self.masks.append(m)
        self.length = np.array([len(x) for x in items], np.int64)
        self.need = np.array([math.ceil(LCS_SHARE * n) if n >= SHORT else n for n in self.length.tolist()], np.int64)
        numbers = [terms.of(x) for x in items]
        self.answers = []
        for n in numbers:
            rare = sorted(Counter(n.tolist()), key=lambda t: (-terms.idf[t], t))[:ANSWER_WORDS]
            self.answers.append({int(terms.hash[t]) for t in rare})
        self.answer_numbers = np.full((len(items), ANSWER_WORDS), -2)
        for i, n in enumerate(numbers):
            rare = terms.of(np.array(sorted(self.answers[i]), U))
            self.answer_numbers[i, : len(rare)] = rare
        item, place = np.nonzero(self.answer_numbers >= 0)
        by = np.argsort(self.answer_numbers[item, place], kind="stable")
        term = self.answer_numbers[item, place][by]
        self.asked = item[by], place[by]  # item and place of every answer word, by term, and for each term its first and their number
        self.asked_first = np.searchsorted(term, np.arange(len(terms.hash) + 1))
        self.asked_count = np.diff(np.append(self.asked_first, len(term)))
        self.answer_need = np.array([math.ceil(ANSWER_SHARE * len(a)) for a in self.answers], np.int64)
        # items and their terms as sorted keys item * width + term
        self.width = len(terms.hash) + 1
        self.has = np.unique(np.concatenate([np.empty(0, np.int64), *(i * self.width + n for i, n in enumerate(numbers))]))
        group = np.repeat(np.arange(len(items)), self.length)
        g, s, weight = _entries(terms, np.concatenate(numbers) if numbers else np.empty(0, np.int64), group)
        q = _grouped(g, basis[s] * weight[:, None], len(items)) if basis.size else np.zeros((len(items), 1), np.float32)
        norm = np.linalg.norm(q, axis=1)
        self.latent = norm > 1e-6
        self.queries = q / np.maximum(norm, 1e-6)[:, None]
        self.least = (COSINE * np.sqrt(np.minimum(1.0, self.length / (2 * BLOCK)))).astype(np.float32)
        self.least[self.length == 0] = 9  # an empty item is found nowhere

    def candidates(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first block, item, cosine) of passages near an item; the blocks' texts and edges.

        Items without a projection, all of whose words are too frequent, are near every passage.
        """
        block, text, edge = _blocks_of(w)
        self.numbers = self.terms.of(w.hash)
        n = len(text)
        if not n or not len(self.ids):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32), text, edge
        g, s, weight = _entries(self.terms, self.numbers, block)
        x = _grouped(g, self.basis[s] * weight[:, None], n) if self.basis.size else np.zeros((n, 1), np.float32)
        x[:-1][text[:-1] == text[1:]] += x[1:][text[:-1] == text[1:]]
        norm = np.linalg.norm(x, axis=1)
        live = np.flatnonzero(norm > 1e-6)
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
        for a in range(0, len(live), 4096):
            part = live[a : a + 4096]
            cosine = (x[part] / norm[part][:, None]) @ self.queries.T
            i, j = np.nonzero((cosine >= self.least[None, :]) & self.latent[None, :])
            out.append((part[i], j, cosine[i, j]))
        for j in np.flatnonzero(~self.latent & (self.length > 0)).tolist():
            out.append((np.arange(n), np.full(n, j), np.zeros(n, np.float32)))
        at, item, cosine = (np.concatenate(c) for c in zip(*out, strict=True))
        return at, item, cosine, text, edge

    def answered(self, at: np.ndarray, item: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Whether enough of the item's answer words stand in the blocks around a passage: never false where the checks hold.

        Answer words are rare, so their places, each spread over the passages that it may belong to, are few.
        """
        asked_item, place = self.asked
        live = np.flatnonzero(self.numbers >= 0)
        times = self.asked_count[self.numbers[live]]
        live, times = live[times > 0], times[times > 0]
        word = np.repeat(live, times)
        which = np.arange(len(word)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.asked_first[self.numbers[live]], times)
        block = np.searchsorted(edge, word, "right") - 1
        most = int(self.length.max(initial=0))
        reach = np.arange(-(most + most // 4) // BLOCK - 3, most // BLOCK + 2)
        n = len(self.ids)
        count = np.zeros(len(at), np.int64)
        for k in range(ANSWER_WORDS):
            mine = place[which] == k
            keys = np.unique((block[mine][:, None] + reach[None, :]) * n + asked_item[which[mine]][:, None])
            if len(keys):
                spot = np.minimum(np.searchsorted(keys, at * n + item), len(keys) - 1)
                count += keys[spot] == at * n + item
        return count >= self.answer_need[item]

    def matched(self, j: int, words: list[int]) -> int:
        """The longest common subsequence of item j and any stretch of these words that passes the checks, else 0.

        The whole bounds every stretch; a stretch need only begin at a word of the item.
        """
        own, masks, need, n = self.words[j], self.masks[j], int(self.need[j]), int(self.length[j])
        most, size, best = lcs(own, words, masks), n + n // 4 if n >= SHORT else n, 0
        if most < need:
            return 0
        for s in range(max(1, len(words) - need + 1)):
            if words[s] in masks:
                stretch = words[s : s + size]
                got = lcs(own, stretch, masks)
                if got >= need and got > best and len(self.answers[j].intersection(stretch)) >= self.answer_need[j]:
                    best = got
                    if best == most:
                        break
        return best

    def search(self, texts: list[bytes]) -> list[tuple[int, int, float, int]]:
        """(text number, item number, cosine, LCS) of every text and item that pass the checks."""
        w = bare_words(texts)
        at, item, cosine, text, edge = self.candidates(w)
        if len(at):
            near = self.answered(at, item, edge)
            at, item, cosine = at[near], item[near], cosine[near]
        # the answer, and as many of the item's words as a subsequence needs, must stand near the passage at all
        first, last = w.first[text[at]], w.first[text[at] + 1]
        reach = self.length[item] // 4
        begin = np.maximum(first, edge[at] - self.length[item])
        end = np.minimum(last, edge[np.minimum(at + 2, len(edge) - 1)] + self.length[item] + reach)
        found: dict[tuple[int, int], tuple[float, int]] = {}
        keep = []
        for a in range(0, len(at), 20000):
            b = slice(a, a + 20000)
            width = int((end[b] - begin[b]).max(initial=0))
            spot = begin[b][:, None] + np.arange(width)[None, :]
            inside = spot < end[b][:, None]
            near = np.where(inside, self.numbers[np.minimum(spot, len(self.numbers) - 1)], -1)
            answered = sum((near == self.answer_numbers[item[b]][:, k, None]).any(axis=1).astype(np.int64) for k in range(ANSWER_WORDS))
            enough = answered >= self.answer_need[item[b]]
            keys = item[b][enough][:, None] * self.width + near[enough]
            spots = np.minimum(np.searchsorted(self.has, keys), len(self.has) - 1)
            enough[enough] = ((near[enough] >= 0) & (self.has[spots] == keys)).sum(axis=1) >= self.need[item[b][enough]]
            keep.append(enough)
        for i in np.flatnonzero(np.concatenate(keep) if keep else np.empty(0, bool)).tolist():
            j, t = int(item[i]), int(text[at[i]])
            n, words = int(self.length[j]), w.hash[begin[i] : end[i]].tolist()
            best = found.get((t, j), (0.0, 0))
            if best[1] < n:
                got = self.matched(j, words)
                if got > best[1]:
                    found[t, j] = (max(best[0], float(cosine[i])), got)
        return [(t, j, c, got) for (t, j), (c, got) in sorted(found.items())]


def _lowered(column: str) -> Column:
    """Letters of every script lowered, as UTF-8 bytes."""
    return F.lower(F.col(column)).cast("binary")


def blocks(benchmark: DataFrame, id_column: str = "item_id", most: int = MAX_WORDS) -> Iterator[tuple[list, list[np.ndarray]]]:
    """The items, ids and hashed words, in blocks of at most `most` words or of one item. Items with a null text are empty."""
    prepared(benchmark.sparkSession)
    ids, items, held = [], [], 0
    for row in benchmark.select(id_column, F.coalesce(_lowered("text"), F.lit(b""))).orderBy(id_column).toLocalIterator():
        words = bare_words([bytes(row[1])]).hash
        if ids and held + len(words) > most:
            yield ids, items
            ids, items, held = [], [], 0
        ids.append(row[0])
        items.append(words)
        held += len(words)
    yield ids, items


def index(docs: DataFrame, ids: list, items: list[np.ndarray], rank: int = RANK) -> Index:
    """Build the index of a block of items over all passages of docs."""
    spark = docs.sparkSession
    given = docs.select(_lowered("text").alias("text"))
    known = spark.sparkContext.broadcast(Terms(items))
    df = _gathered(given.mapInArrow(_frequencies(known), "piece int, of int, part binary"))
    terms = Terms(items, df if len(df) else None)
    width = rank + OVERSAMPLING
    omega = _omega(terms.size, width)
    sketch = np.zeros((terms.size, width), np.float32)
    if terms.size:
        total = _gathered(given.mapInArrow(_sketched(spark.sparkContext.broadcast(terms), width), "piece int, of int, part binary"))
        add_sketch(sketch, omega, *_entries(terms, terms.of(np.concatenate(items)), np.repeat(np.arange(len(items)), [len(x) for x in items])))
        sketch = sketch.astype(np.float64) + (total.reshape(sketch.shape) if total.size else 0)
    return Index(ids, items, terms, singular_vectors(sketch, omega, rank))


def _searched(shared, item_type: pa.DataType):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = shared.value
        for batch in it:
            for at, texts in batches(batch.column(1).to_pylist()):
                hits = own.search(texts)
                ids = batch.column(0).take(pa.array([at + t for t, *_ in hits], pa.int64()))
                item = pa.array([own.ids[j] for _, j, *_ in hits], item_type)
                share = pa.array([round(got / len(own.words[j]), 6) for _, j, _, got in hits], pa.float64())
                yield pa.record_batch(
                    [ids, item, pa.array([round(c, 4) for _, _, c, _ in hits], pa.float64()), pa.array([got for *_, got in hits], pa.int64()), share],
                    names=["doc_id", "item_id", "cosine", "lcs", "lcs_share"],
                )

    return run


def find(docs: DataFrame, benchmark: DataFrame, id_column: str = "item_id", rank: int = RANK) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, lcs_share), one row for each row of docs and item that it holds.

    A null, empty or blank text holds nothing, an empty item is held by nothing; equal items are found each.
    Repeated rows give repeated results. An empty table gives an empty result; other columns are not read.
    Ids of documents and items may have any type that a table can hold.
    """
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)[id_column]
    given = docs.select("doc_id", _lowered("text").alias("text"))
    out = None
    for ids, items in blocks(benchmark, id_column):
        built = docs.sparkSession.sparkContext.broadcast(index(docs, ids, items, rank))
        part = given.mapInArrow(_searched(built, to_arrow_type(benchmark.schema[id_column].dataType)), f"doc_id {kind}, item_id {item_kind}, cosine double, lcs bigint, lcs_share double")
        out = part if out is None else out.unionByName(part)
    return out


def _cleaned(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = shared.value
        for batch in it:
            keep = np.ones(batch.num_rows, bool)
            for at, texts in batches(batch.column(batch.num_columns - 1).to_pylist()):
                for t, *_ in own.search(texts):
                    keep[at + t] = False
            yield pa.record_batch(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(keep))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "item_id", rank: int = RANK) -> DataFrame:
    """The rows of docs, all columns, that hold no item. Each row is judged by its own text."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # columns go by position, so names cannot clash
    types = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))
    out = docs.toDF(*names)
    for ids, items in blocks(benchmark, id_column):
        built = docs.sparkSession.sparkContext.broadcast(index(docs, ids, items, rank))
        out = out.withColumn("text_", _lowered(names[docs.columns.index("text")])).mapInArrow(_cleaned(built), types)
    return out.toDF(*docs.columns)
