"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

The model is P(grade <= j | x) = logistic(threshold_j - w . x), with one weight vector shared by all grades and
thresholds in ascending order. x holds, for every hash slot, the share of a document's words that bear one of
its features, so a document's length alone moves nothing. A word's features are its hash, its shape (the runs
of character classes in it: lower, upper, digit, other letter, and each punctuation mark as itself), its last
mark, whether it repeats the word before it, and the shape pair with the word before it.

Learning reads a bounded sample: up to ROWS rated rows of each grade, in the order of a hash of their ids, by
full-batch Adam on the likelihood. Features are made where the texts are. Weights of 2**BITS slots go to every task. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepared
from .hashing import LOWER, U, batches, hash_spans, mix, words_of
from .toxicity import training_entries

BITS = 16
ROWS = 3000
STEPS = 120
RATE = 0.5
L2 = 1e-4
#: The least probability of the wanted grade at which a document is selected.
SELECT_AT = 0.5

#: Character classes: blanks 0, lower 1, upper 2, digits 3, outside ASCII 4, any other mark its own.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, slot, share) of every feature of a batch of texts."""
    w = words_of(texts, lower=False)
    if not len(w.hash):
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0)
    kind = _CLASS[w.buffer]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[w.start] = True
    # the buffer with one byte a run of a class: shapes are spans of it
    runs = kind[new]
    before = np.cumsum(new) - 1
    shape = hash_spans(runs, before[w.start], before[w.end - 1] + 1)
    lowered = hash_spans(LOWER[w.buffer], w.start, w.end)
    last = kind[w.end - 1].astype(U)
    second = np.where(w.end - w.start > 1, kind[np.maximum(w.end - 2, 0)], 0).astype(U)
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.text[1:] == w.text[:-1]) & (lowered[1:] == lowered[:-1])
    back = np.ones(len(w.hash), U)
    back[1:] = np.where(w.text[1:] == w.text[:-1], shape[:-1], U(1))
    hashes = [lowered + U(1), shape + U(2), mix(last * U(977) + second) + U(3), mix(same.astype(U) + U(5)), mix(shape * U(3) + mix(back)) + U(7)]
    share = 1.0 / np.maximum(1, np.diff(w.first))[w.text]
    slot = np.concatenate([(mix(h) & U((1 << bits) - 1)).astype(np.int32) for h in hashes])
    return np.tile(w.text, len(hashes)), slot, np.tile(share, len(hashes))


def entries(texts: list[bytes | None], bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slots, shares) of each text, with one entry for a slot."""
    out = []
    for _, batch in batches(texts):
        text, slot, share = features(batch, bits)
        both, where = np.unique(text << 32 | slot, return_inverse=True)
        share = np.bincount(where, share, len(both)).astype(np.float32)
        edge = np.searchsorted(both >> 32, np.arange(len(batch) + 1))
        slot = (both & 0xFFFFFFFF).astype(np.int32)
        out += [(slot[edge[k] : edge[k + 1]], share[edge[k] : edge[k + 1]]) for k in range(len(batch))]
    return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def grade_probabilities(latent: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade = j), a row for each latent value and a column for each grade."""
    below = np.concatenate([np.zeros((len(latent), 1)), _logistic(thresholds[None, :] - latent[:, None]), np.ones((len(latent), 1))], axis=1)
    return np.diff(below, axis=1)


def fit(made: list[tuple[np.ndarray, np.ndarray]], grades: list[int], n_grades: int, bits: int = BITS, steps: int = STEPS, rate: float = RATE, l2: float = L2) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) that maximise the mean log-likelihood of the grades, 0 to n_grades - 1, of texts with these entries.

    thresholds are the first one and the running sum of exponentials, so they ascend whatever the steps do.
    """
    y = np.array(grades, np.int64)
    row = np.repeat(np.arange(len(made), dtype=np.int32), [len(s) for s, _ in made])
    slot = np.concatenate([np.empty(0, np.int32), *(s for s, _ in made)])
    share = np.concatenate([np.empty(0, np.float32), *(x for _, x in made)])
    w, t = np.zeros(1 << bits), np.concatenate([[-1.0], np.zeros(max(0, n_grades - 2))])
    m, v = np.zeros(len(w) + len(t)), np.zeros(len(w) + len(t))
    at = np.arange(len(y))
    for step in range(1, (steps if len(y) else 0) + 1):
        gaps = np.exp(np.clip(t[1:], -20, 20))
        thresholds = t[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        latent = np.bincount(row, w[slot] * share, len(y))
        edge = np.concatenate([np.full((len(y), 1), -np.inf), thresholds[None, :] - latent[:, None], np.full((len(y), 1), np.inf)], axis=1)
        low, high = edge[at, y], edge[at, y + 1]
        f_low, f_high = _logistic(low) * np.isfinite(low), np.where(np.isfinite(high), _logistic(high), 1.0)
        p = np.maximum(f_high - f_low, 1e-9)
        d_low, d_high = f_low * (1 - f_low) / p, f_high * (1 - f_high) / p
        g_latent = (d_high - d_low) / len(y)  # of the mean negative log-likelihood
        g_edge = np.zeros((len(y), n_grades + 1))
        g_edge[at, y] += d_low / len(y)
        g_edge[at, y + 1] -= d_high / len(y)
        g_thresholds = g_edge[:, 1:n_grades].sum(axis=0)
        g_t = np.concatenate([[g_thresholds.sum()], np.cumsum(g_thresholds[::-1])[::-1][1:] * gaps])
        g = np.concatenate([np.bincount(slot, share * g_latent[row], len(w)) + l2 * w, g_t])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, t = w - move[: len(w)], t - 0.1 * move[len(w) :]
    return w, t[0] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(t[1:], -20, 20)))])


def _scored(w: np.ndarray, thresholds: np.ndarray, grades: np.ndarray, wanted: int, select_at: float, bits: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            text_at, others = batch.num_columns - 1, batch.columns[:-1]
            for at, texts in batches(batch.column(text_at).to_pylist()):
                text, slot, share = features(texts, bits)
                p = grade_probabilities(np.bincount(text, w[slot] * share, len(texts)), thresholds)
                tail = np.round(p[:, wanted:].sum(axis=1), 6)
                yield pa.record_batch(
                    [*[c.slice(at, len(texts)) for c in others], pa.array(np.round(p @ grades, 6)), pa.array(tail), pa.array(tail >= select_at)],
                    names=[*batch.schema.names[:-1], "expected_grade", "tail_probability", "selected"],
                )

    return run


class Model:
    """Weights, thresholds and the grades they tell apart, in ascending order."""

    def __init__(self, docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS, bits: int = BITS, steps: int = STEPS):
        prepared(docs.sparkSession)
        sample = training_entries(docs, labels, label, rows, "quality", lambda texts: entries(texts, bits))
        self.grades = sorted({g for *_, g in sample}) or [0]
        self.bits = bits
        rank = {g: i for i, g in enumerate(self.grades)}
        if len(self.grades) > 1:
            self.weights, self.thresholds = fit([x[:2] for x in sample], [rank[g] for *_, g in sample], len(self.grades), bits, steps)
        else:
            self.weights, self.thresholds = np.zeros(1 << bits), np.empty(0)

    def score(self, docs: DataFrame, wanted: int | None = None, select_at: float = SELECT_AT) -> DataFrame:
        """See score()."""
        at = len(self.grades) - 1 if wanted is None else min((i for i, g in enumerate(self.grades) if g >= wanted), default=len(self.grades))
        # columns go by position, so whatever names docs has cannot clash
        types = [f.dataType.simpleString() for f in docs.schema.fields]
        inner = [f"c{i} {t}" for i, t in enumerate(types)]
        given = docs.toDF(*[f"c{i}" for i in range(len(types))]).withColumn("text_", F.col(f"c{docs.columns.index('text')}").cast("binary"))
        out = given.mapInArrow(
            _scored(self.weights, self.thresholds, np.array(self.grades, float), at, select_at, self.bits),
            ", ".join([*inner, "expected_grade double", "tail_probability double", "selected boolean"]),
        )
        return out.toDF(*docs.columns, "expected_grade", "tail_probability", "selected")


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", wanted: int | None = None, select_at: float = SELECT_AT, rows: int = ROWS) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, selected), one row for each row of docs.

    expected_grade is the mean of the grades under the model, tail_probability that of a grade of `wanted` or
    more (the highest grade by default), selected whether it reaches select_at. Grades are the values that
    `label` takes in rated rows with a text and an id. With one grade or none the model is constant: every row
    has that grade (0 without ratings) with probability 1. A null or empty text has no features and is judged
    by the thresholds alone. Repeated rows are scored alike, an empty table gives an empty result, other
    columns of docs and labels are not read.
    """
    return Model(docs, labels, label, rows).score(docs.select("doc_id", "text"), wanted, select_at).drop("text")
