"""Children in their parents: where each stands if there is one way only, and the one overlap of two neighbours.

Texts are compared by polynomial hashes over numpy arrays of their code points, so all windows of a length, and all prefixes
or suffixes, take one pass; what hashes alike is compared in full. Time is linear in a parent and its children, but for places
that are taken by many children at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Characters by which a child's places are looked for; a shorter child is its own seed.
SEED = 24
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)
_U = np.uint64
# What is known of a parent's children.
UNIQUE, AMBIGUOUS, NONE = "unique", "ambiguous", "none"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hashed:
    """Sums of a text's code points times powers, by which any stretch of it has a hash that does not depend on its place."""

    def __init__(self, text: str):
        self.text = text
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U) + _U(1)
        self.sums = np.zeros(len(points) + 1, _U)
        np.cumsum(points * _powers(_P, len(points)), out=self.sums[1:])
        self.back = _powers(_INVERSE, len(points) + 1)

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def places(parent: str, children: list[str]) -> list[list[int]]:
    """Of each child, all its places in the parent; of an empty child, none."""
    whole, seeds = Hashed(parent), {}
    for k, child in enumerate(children):
        seeds.setdefault(min(len(child), SEED), {}).setdefault(child[:SEED], []).append(k)
    out: list[list[int]] = [[] for _ in children]
    for size, wanted in seeds.items():
        if not 0 < size <= len(parent):
            continue
        start = np.arange(len(parent) - size + 1)
        windows = whole.at(start, start + size)
        keys = np.array([Hashed(seed).at(np.array([0]), np.array([size]))[0] for seed in wanted], _U)
        for at in np.flatnonzero(np.isin(windows, keys)).tolist():
            for k in wanted.get(parent[at : at + size], ()):
                if parent.startswith(children[k], at):
                    out[k].append(at)
    return out


def ways(length: int, sizes: list[int], found: list[list[int]]) -> tuple[str, list[int]]:
    """Whether there is one way to place children in order, from the parent's start to its end, each behind the start of the one before and without
    a gap to it; and the starts, if so. Ways to each place are counted up to two by sums over the places of the child before."""
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of each child: its places, ways to them, a place before
    for k, at in enumerate(found):
        start = np.array(at, np.int64)
        if k == 0:
            start = start[start == 0]
            levels.append((start, np.ones(len(start), np.int64), np.zeros(len(start), np.int64)))
            continue
        before, n, _ = levels[-1]
        sums = np.concatenate([[0], np.cumsum(n)])
        low, high = np.searchsorted(before, start - sizes[k - 1]), np.searchsorted(before, start)
        here = low < high
        levels.append((start[here], np.minimum(2, sums[high] - sums[low])[here], low[here]))
    if not levels:
        return NONE, []
    start, n, _ = levels[-1]
    last = np.flatnonzero(start + sizes[-1] == length)
    if not len(last):
        return NONE, []
    if n[last].sum() > 1:
        return AMBIGUOUS, []
    x, out = int(last[0]), []
    for start, _, before in reversed(levels):
        out.append(int(start[x]))
        x = int(before[x])
    return UNIQUE, out[::-1]


def align(parent: str | None, children: list[str] | None) -> tuple[str, list[int], list[tuple[int, int]]]:
    """(state, starts, spans): see alignment()."""
    parent = parent or ""
    at = [i for i, c in enumerate(parent) if not c.isspace()]
    bare, kids = "".join(parent[i] for i in at), ["".join((k or "").split()) for k in (children if children is not None else [])]
    sizes = [len(k) for k in kids]
    state, starts = ways(len(bare), sizes, places(bare, kids))
    return state, starts, [(at[i], at[i + n - 1] + 1) for i, n in zip(starts, sizes)]


_SPAN = StructType([StructField("begin", IntegerType()), StructField("end", IntegerType())])
_ALIGNED = StructType([StructField("state", StringType()), StructField("starts", ArrayType(IntegerType())), StructField("spans", ArrayType(_SPAN))])


def alignment(parent: Column, children: Column) -> Column:
    """(state, starts, spans) of children, an array of texts in order, in their parent.

    Blanks of any kind do not count: starts are places among the other characters, spans (begin, end) lie in the parent as it is. The children
    must cover the parent from its first character to its last, in order, each starting behind the one before and not behind its end. unique:
    there is one way; ambiguous: several; none: no way, or no children. Only the first has starts and spans.
    """

    def run(p: pd.Series, kids: pd.Series) -> pd.DataFrame:
        rows = [align(x, y) for x, y in zip(p, kids, strict=True)]
        return pd.DataFrame({"state": [r[0] for r in rows], "starts": [r[1] for r in rows], "spans": [[{"begin": b, "end": e} for b, e in r[2]] for r in rows]})

    return F.pandas_udf(run, _ALIGNED)(parent, children)


def overlaps(left: str, right: str, least: int = 1) -> list[int]:
    """All lengths, `least` or more, of what ends left and starts right."""
    n = np.arange(least, min(len(left), len(right)) + 1)
    if not len(n):
        return []
    a, b = Hashed(left[-int(n[-1]) :]), Hashed(right[: int(n[-1])])
    whole = np.full(len(n), n[-1])
    same = a.at(whole - n, whole) == b.at(np.zeros_like(n), n)
    return [int(k) for k in n[same] if left.endswith(right[:k])]


_STITCHED = StructType([StructField("length", IntegerType()), StructField("n", IntegerType())])


def overlap(left: Column, right: Column, least: int = 1) -> Column:
    """(length, n): the longest overlap of `least` or more that ends left and starts right, null without one, and how many there are."""

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [overlaps(p or "", q or "", least) for p, q in zip(x, y, strict=True)]
        return pd.DataFrame({"length": pd.array([max(r, default=None) for r in rows], "Int32"), "n": pd.array([len(r) for r in rows], "Int32")})

    return F.pandas_udf(run, _STITCHED)(left, right)
