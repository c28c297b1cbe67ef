"""Near vectors against all pairs in numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import near_vectors as N

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, cosine=0.98):
    """(vec_id, n_links, component_id, kept) of distinct ids by all pairs."""
    good = [(i, np.array(v, np.float32).astype(np.float64), lab) for i, v, lab in rows if i is not None and lab is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    links = {r[0]: set() for r in rows}
    for lab, dim in {(g[2], len(g[1])) for g in good}:
        part = [g for g in good if g[2] == lab and len(g[1]) == dim]
        x = np.array([g[1] / np.linalg.norm(g[1]) for g in part])
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= cosine, 1))):
            links[part[a][0]].add(part[b][0])
            links[part[b][0]].add(part[a][0])
    least = {i: i for i in links}
    moved = True
    while moved:
        moved = False
        for i, near in links.items():
            m = min([least[i], *[least[j] for j in near]], key=lambda x: (x is None, x))
            moved |= m != least[i]
            least[i] = m
    return sorted([(i, len(links[i]), least[i], least[i] == i) for i in links], key=repr)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _near(draw, v, cosine):
    """A vector at exactly this cosine from v."""
    v = v / np.linalg.norm(v)
    other = draw.standard_normal(len(v))
    other -= (other @ v) * v
    return cosine * v + math.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


def _planted(seed, n=600, dim=24):
    draw = np.random.default_rng(seed)
    rows = [(i, draw.standard_normal(dim).tolist(), int(draw.integers(3))) for i in range(n)]
    for i in range(n, n + 300):  # pairs around the threshold, chains, other lengths, labels that differ
        source = rows[int(draw.integers(n, i)) if i > n + 9 and i % 3 == 0 else int(draw.integers(n))]
        v = _near(draw, np.array(source[1]), draw.choice([0.9701, 0.9799, 0.9801, 0.985, 0.999])) * float(draw.choice([1e-3, 1, 1e3]))
        rows.append((i, v.tolist(), source[2] if i % 7 else 5))
    hub = draw.standard_normal(dim)
    rows += [(i, _near(draw, hub, 0.995).tolist(), 1) for i in range(2000, 2150)]  # a family of near copies
    rows += [(i, rows[3][1], rows[3][2]) for i in range(3000, 3100)]  # and one of exact ones
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(N, "CHUNK", 16)  # so that the families are dealt
    rows = _planted(seed)
    got = _rows(N.link(spark.createDataFrame(rows, SCHEMA).repartition(7), miss=1e-7))
    assert got == plain(rows)


def test_recall_at_the_threshold(spark):
    """Of 2,000 pairs that are only just near enough, at most one or two are missed, and there is no false link."""
    draw = np.random.default_rng(8)
    rows = []
    for i in range(2000):
        v = draw.standard_normal(64)
        rows += [(2 * i, v.tolist(), 0), (2 * i + 1, _near(draw, v, 0.98001).tolist(), 0)]
    got = {r.vec_id: r for r in N.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = sum(got[2 * i + 1].component_id == 2 * i for i in range(2000))
    assert found >= 1998 and all(r.n_links <= 1 for r in got.values())


def test_plan_is_calibrated():
    for vectors in (10, 10**4, 10**9):
        p = N.plan(0.98, vectors, 1e-4)
        near = N._same_strip(0.2, p.strip) ** p.strips * math.erf(2 / math.sqrt(2))
        assert N.missed(near, p.tables) <= 1e-4 < N.missed(near, p.tables - 1)
        assert vectors * N._same_strip(math.sqrt(2), p.strip) ** p.strips <= 1 / N.SPARE
    assert N.plan(0.98, 10**9, 1e-4).tables < 6 * N.plan(0.98, 10**4, 1e-4).tables
    with pytest.raises(ValueError):
        N.plan(1.0, 10, 1e-4)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [], 1), (10, [1.0, 0.0], 2), (11, [1.0, 0.0, 0.0], 1), (12, [-0.0, 3.0], 2), (13, [1e-38, 1e-38], 1), (14, [1e38, 1e38], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.select("*", *[F.lit(1).alias(c) for c in ("node", "held", "t", "key", "cell", "size", "sound", "h1", "kept", "component_id", "value")])
    assert _rows(N.link(clash)) == plain(rows)
    assert [r[:3] for r in plain(rows) if r[1]] == [(1, 1, 1), (13, 1, 13), (14, 1, 13), (2, 1, 1)]
    assert N.link(df.limit(0)).collect() == []
    null = spark.createDataFrame([(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)], SCHEMA)
    assert _rows(N.link(null)) == [(1, 0, 1, True), (None, 0, None, True)]


def test_repeated_rows_and_other_ids(spark):
    rows = [("b", [1.0, 0.0], "x"), ("b", [1.0, 0.0], "x"), ("a", [1.0, 0.1], "x"), ("c", [0.0, 1.0], "x"), ("b", [0.0, 1.0], "x")]
    got = _rows(N.link(spark.createDataFrame(rows, "vec_id string, embedding array<double>, label string")))
    assert got == [("a", 1, "a", True), ("b", 1, "a", False), ("b", 1, "a", False), ("b", 1, "b", True), ("c", 1, "b", False)]
