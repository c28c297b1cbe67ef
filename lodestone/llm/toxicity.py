"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

A document's features are the distinct hashes, modulo 2**BITS, of its words, of their first bytes (a word's
stem, so that inflected forms share a feature), of neighbouring word pairs and of pairs that skip one word.
Every coordinate has its own learning rate, from the sum of its squared gradients, and L1 regularisation
leaves most weights at zero. What is left, a few thousand (slot, weight) pairs and at most 2**BITS of them,
goes to every task.

Learning reads a bounded sample: up to ROWS labelled rows of each label in the order of a hash of their ids, and of
these as many as have MOST_ENTRIES features together. Features are made where the texts are; only slots come to the driver. Each epoch runs through them in that order, so a rerun learns the same weights. Scoring reads all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_hash, prepared, staged
from .hashing import U, Words, batches, grams, hash_spans, mix, words_of

BITS = 20
STEMS = (4, 5, 6, 7)
#: The most labelled rows of each label that are learned from.
ROWS = 5000
#: The most features (slots of a text) that are learned from: 64 MB of them.
MOST_ENTRIES = 1 << 24
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.2
THRESHOLD = 0.7


#: Bytes that belong to words here: ASCII letters and digits, and everything outside ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _trimmed(w: Words) -> tuple[Words, np.ndarray]:
    """The words without what stands around their first and last letter; those without letters go."""
    at = np.flatnonzero(_LETTER[w.buffer])
    if not len(at):
        return w._replace(hash=w.hash[:0], text=w.text[:0], start=w.start[:0], end=w.end[:0]), at
    i, j = np.searchsorted(at, w.start), np.searchsorted(at, w.end)
    has = np.flatnonzero(i < j)
    start, end = at[i[has]], at[j[has] - 1] + 1
    return w._replace(hash=hash_spans(w.buffer, start, end), text=w.text[has], start=start, end=end), has


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of every feature of a batch of texts, repeats included."""
    w, _ = _trimmed(words_of(texts))
    mask = U((1 << bits) - 1)
    out = [(w.text, w.hash)]
    for n in STEMS:
        long = np.flatnonzero(w.end - w.start > n)
        out.append((w.text[long], hash_spans(w.buffer, w.start[long], w.start[long] + n) + U(n)))
    pair, at = grams(w, 2)
    out.append((w.text[at], pair))
    if len(w.hash) > 2:
        at = np.flatnonzero(w.text[:-2] == w.text[2:])
        out.append((w.text[at], mix(w.hash[at] * U(3) + mix(w.hash[at + 2])) + U(11)))
    return np.concatenate([t for t, _ in out]), np.concatenate([(mix(h) & mask).astype(np.int32) for _, h in out])


def feature_sets(texts: list[bytes | None], bits: int = BITS) -> list[np.ndarray]:
    """Of each text, its distinct slots."""
    out = []
    for _, batch in batches(texts):
        text, slot = features(batch, bits)
        both = np.unique(text.astype(np.int64) << 32 | slot)
        edge = np.searchsorted(both >> 32, np.arange(len(batch) + 1))
        out += [(both[edge[k] : edge[k + 1]] & 0xFFFFFFFF).astype(np.int32) for k in range(len(batch))]
    return out


class Ftrl:
    """FTRL-proximal for logistic loss on sets of slots; slot 2**bits is the intercept, free of L1."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.last = 1 << bits

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        l1 = np.where(i == self.last, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, slots: np.ndarray, label: int) -> float:
        i = np.append(slots, self.last)
        w = self.weights(i)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        self.z[i] += g - sigma * w
        self.n[i] += g * g
        return p


def fit(sample: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots, weights, intercept) with nonzero weights only, learned from (slots of a text, label) in this order."""
    model = Ftrl(bits)
    for _ in range(epochs):
        for s, label in sample:
            model.learn(s, label)
    slots = np.flatnonzero(np.abs(model.z[:-1]) > model.l1)
    return slots.astype(np.int32), model.weights(slots), float(model.weights(np.array([model.last]))[0])


def _scored(slots: np.ndarray, weights: np.ndarray, intercept: float, bits: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << bits, np.float64)
        dense[slots] = weights
        for batch in it:
            held = batch.column(1)
            for at, texts in batches(batch.column(2).to_pylist()):
                text, slot = features(texts, bits)
                live = np.flatnonzero(dense[slot])
                both = np.unique(text[live].astype(np.int64) << 32 | slot[live])
                sums = np.bincount(both >> 32, dense[both & 0xFFFFFFFF], len(texts)) + intercept
                yield pa.record_batch(
                    [batch.column(0).slice(at, len(texts)), held.slice(at, len(texts)), pa.array(np.round(1 / (1 + np.exp(-np.clip(sums, -35, 35))), 6))],
                    names=["doc_id", "held_out", "score"],
                )

    return run


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether the fold of a row is the held-out one: crc32 of the id as text, modulo 3, is 1."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sampled(labelled: DataFrame, label: str, rows: int, seed: str) -> DataFrame:
    """Of labelled (doc_id, label), up to `rows` rows of each value of the label, the first by a hash of the id.

    Each value's share of rows is cut by a threshold on the uniform hash, a little high, and the bound then
    holds by the order; so no value's rows meet in one task.
    """
    counts = {r[label]: r["count"] for r in labelled.groupBy(label).count().collect()}
    out = None
    for value, count in sorted(counts.items()):
        part = labelled.where(F.col(label) == value).withColumn("_order", id_hash(seed, "doc_id"))
        if count > rows:
            part = part.where(F.col("_order") < int((1 << 60) * min(1.0, 1.2 * rows / count + 50 / count)))
        part = part.orderBy("_order", "doc_id").limit(rows)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else labelled.withColumn("_order", F.lit(0).cast("bigint")).limit(0)


def _entries(featurise):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at, texts in batches(batch.column(2).to_pylist()):
                made = featurise(texts)
                packed = [pa.array([x.tobytes() for x in column], pa.binary()) for column in zip(*made, strict=True)]
                n = pa.array([len(x[0]) for x in made], pa.int64())
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), n, *packed], names=["_order", "label", "n", "slots", "shares"])

    return run


def training_entries(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, seed: str, featurise, training: Column | None = None, most: int = MOST_ENTRIES
) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(slots, shares, label) of the sample's texts, in the order of its hash; at most `rows` for each value of the label,
    and the first of them that have `most` slots together.

    featurise gives (slots as int32, shares as float32) of each text of a list; it runs where the texts are. Rows without
    an id, label or text are not learned from; an id with several labels or texts counts each.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if training is not None:
        known = known.where(training)
    chosen = sampled(known, "label", rows, seed)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where(F.col("text").isNotNull())
    made = texts.join(F.broadcast(chosen), "doc_id").select("_order", "label", "text").mapInArrow(_entries(featurise), "_order bigint, label int, n bigint, slots binary, shares binary")
    made = staged(made, "training")
    # rows are told apart by (_order, label) only, so the cut falls between two such keys
    sizes = made.groupBy("_order", "label").agg(F.sum("n").alias("n")).orderBy("_order", "label").toArrow()
    fits = int(np.searchsorted(np.cumsum(sizes["n"].to_numpy()), most, "right"))
    if fits < sizes.num_rows:
        order, value = (sizes[c][fits].as_py() for c in ("_order", "label"))
        made = made.where((F.col("_order") < order) | (F.col("_order") == order) & (F.col("label") < value))
    got = made.select("_order", "label", "slots", "shares").orderBy("_order", "label", "slots", "shares").toArrow()
    return [(np.frombuffer(s.as_py(), np.int32), np.frombuffer(x.as_py(), np.float32), y) for s, x, y in zip(got["slots"], got["shares"], got["label"].to_pylist(), strict=True)]


def _sets(bits: int):
    return lambda texts: [(s, np.empty(0, np.float32)) for s in feature_sets(texts, bits)]


def score(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    rows: int = ROWS,
    epochs: int = EPOCHS,
    threshold: float = THRESHOLD,
    bits: int = BITS,
) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs.

    held_out rows are never learned from. score is the probability of label 1 from the whole text alone; a
    null or empty text has no features and gets the score of the intercept. predicted is 1 from `threshold`
    on. Without labelled rows every score is 0.5. Rows with a null id are scored and not held out. Repeated
    rows are scored alike; an empty table gives an empty result; other columns are not read.
    """
    prepared(docs.sparkSession)
    sample = [(s, y) for s, _, y in training_entries(docs, labels, label, rows, "toxicity", _sets(bits), ~held_out())]
    slots, weights, intercept = fit(sample, bits, epochs)
    del sample
    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("binary").alias("text")).mapInArrow(
        _scored(slots, weights, intercept, bits), f"doc_id {kind}, held_out boolean, score double"
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
