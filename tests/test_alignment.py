"""Alignment and stitching against searches that try everything."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import alignment as A
from lodestone.operators import audit


def plain(parent, children):
    bare, kids = "".join(parent.split()), ["".join(k.split()) for k in children]
    spots = [[i for i in range(len(bare)) if k and bare.startswith(k, i)] for k in kids]
    found = []
    for starts in itertools.product(*spots):
        gaps = all(a < b <= a + len(k) for a, b, k in zip(starts, starts[1:], kids))
        if starts and starts[0] == 0 and gaps and starts[-1] + len(kids[-1]) == len(bare):
            found.append(list(starts))
    return ("none", []) if not found else ("unique", found[0]) if len(found) == 1 else ("ambiguous", [])


def test_every_way_is_counted():
    draw, states = random.Random(3), set()
    for _ in range(3000):
        parent = "".join(draw.choice("ab \n") for _ in range(draw.randint(0, 14)))
        cuts = sorted(draw.randint(0, len(parent)) for _ in range(2))
        children = [parent[: cuts[1]], parent[cuts[0] :]] if draw.random() < 0.5 else [parent[: cuts[0] + 1], parent[cuts[0] : cuts[1] + 1], parent[cuts[1] :]]
        children = [c if draw.random() < 0.9 else c + "b" for c in children][: draw.randint(0, 3)]
        want = plain(parent, children)
        assert A.align(parent, children)[:2] == want, (parent, children)
        states.add(want[0])
    assert states == {"none", "unique", "ambiguous"}


def test_spans_lie_in_the_parent_as_it_is(spark):
    parent = "One\ttwo  \U0001f600 three four"
    row = spark.createDataFrame([(parent, ["On e two", "two\U0001f600thr", "three four"]), (None, None), ("", []), ("aaaaa", ["aa", "aa", "aa"])], "p string, k array<string>").select(A.alignment(F.col("p"), F.col("k")).alias("v"), "p").collect()
    assert [parent[s.begin : s.end] for s in row[0].v.spans] == ["One\ttwo", "two  \U0001f600 thr", "three four"]
    assert [r.v.state for r in row] == ["unique", "none", "none", "ambiguous"]
    assert [(s.begin, s.end) for s in row[0].v.spans] == [(s.begin, s.end) for s in spark.createDataFrame([(parent, ["On e two", "two\U0001f600thr", "three four"])], "p string, k array<string>").select(audit.place_children(F.col("p"), F.col("k")).alias("v")).first().v]


@pytest.mark.parametrize("least", [1, 3])
def test_overlaps(least):
    draw = random.Random(least)
    for _ in range(2000):
        a, b = ("".join(draw.choice("ab") for _ in range(draw.randint(0, 12))) for _ in "ab")
        assert A.overlaps(a, b, least) == [n for n in range(least, min(len(a), len(b)) + 1) if a.endswith(b[:n])]


def test_time_is_linear_in_the_text():
    draw = random.Random(0)

    def took(n):
        parent = "".join(draw.choice("abcdefgh ") for _ in range(n))
        children = [parent[i : i + 400] for i in range(0, n - 100, 300)]
        children[-1] = parent[300 * (len(children) - 1) :]
        began = time.process_time()
        state, starts, _ = A.align(parent, children)
        assert state == "unique" and len(starts) == len(children)
        assert A.overlaps(parent, parent[n // 2 :]) [-1] == n - n // 2
        return time.process_time() - began

    took(10_000)
    assert took(800_000) < 0.3 + 8 * took(200_000)
