"""The n-gram join where many unlike sets share signatures, in long chains, and with ids of other types."""

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import ngram_join as J

SCHEMA = "doc_id bigint, text string"


def _sets(rows, n):
    return {i: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or {tuple(w)} for i, w in ((i, t.split()) for i, t in rows)}


def _links(sets, percent):
    return {i: sum(j != i and 100 * len(s & t) >= percent * len(s | t) for j, t in sets.items()) for i, s in sets.items()}


@pytest.mark.parametrize("unlike", [16, 24])
def test_pages_of_one_template_do_not_meet(spark, unlike, monkeypatch):
    """1,500 texts of 200 words with unlike ends, Jaccard 0.86 and 0.80, none linked: fewer than 2 % of all pairs are looked at."""
    rng, pairs = random.Random(1), []
    template = [f"t{i}" for i in range(200)]
    rows = [(i, " ".join(template[: 200 - unlike] + [f"u{rng.randrange(10**6)}" for _ in range(unlike)])) for i in range(1500)]
    assert {round(len(a & b) / len(a | b), 2) for a, b in [tuple(_sets(rows[:2], 3).values())]} <= {0.85, 0.86, 0.79, 0.8, 0.78}
    inner = J.rare_pairs

    def seen(*args):
        found = J.staged(inner(*args), "seen")
        pairs.append(found.count())
        return found

    monkeypatch.setattr(J, "rare_pairs", seen)
    got = J.join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.component_id == r.doc_id and r.n_links == 0 for r in got)
    assert pairs and sum(pairs) < 0.02 * 1500 * 1499 / 2


@pytest.mark.parametrize(("percent", "n"), [(90, 3), (80, 5)])
def test_rare_shingles_lose_no_link(spark, percent, n, monkeypatch):
    """Every group of signatures and every component of some size goes by rare shingles, dealt in small chunks."""
    for name, value in (("FEW", 2), ("RARE_CHUNK", 4), ("LARGE", 5), ("SPARSE", 0), ("ORDER_SLOTS", 64)):
        monkeypatch.setattr(J, name, value)
    rng, rows = random.Random(3), []
    for _ in range(6):
        base = [f"w{rng.randrange(1200)}" for _ in range(rng.choice((12, 40, 150, 400)))]
        for _ in range(40):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 20))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
            if rng.random() < 0.3:
                base = words
    rows += [(len(rows) + i, " ".join(f"s{k}" for k in range(i + 1))) for i in range(40)]
    sets = _sets(rows, n)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id: r.n_links for r in J.join(df, percent, n).collect()} == _links(sets, percent)
    first = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    heads = sorted(set(first.values()))
    want = {(a, b, len(sets[a] & sets[b])) for a in heads for b in heads if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert {tuple(r) for r in J.pairs(df, percent, n).collect()} == want


def test_a_long_chain_is_linked_by_rare_shingles(spark, monkeypatch):
    """1,200 classes in one component, two links each: no chunk meets all others."""
    dealt = []
    inner = J.verified

    def seen(pairs, *args):
        pairs = J.staged(pairs, "seen")
        dealt.append(pairs.count())
        return inner(pairs, *args)

    monkeypatch.setattr(J, "verified", seen)
    words = [f"c{i}" for i in range(2500)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 60])) for i in range(1200)]
    got = {r.doc_id: (r.component_id, r.n_links) for r in J.join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (0, 2 - (i in (0, 1199))) for i in range(1200)}
    assert dealt[-1] < 40 * 1200


@pytest.mark.parametrize("percent", [90, 80, 65])
def test_first_ones_share_a_shingle(percent):
    rng = np.random.default_rng(percent)
    for _ in range(2000):
        n = int(rng.integers(1, 80))
        x = rng.choice(400, n, replace=False)
        y = np.union1d(rng.choice(x, max(1, n - int(rng.integers(0, n // 4 + 1))), replace=False), rng.choice(400, int(rng.integers(0, n // 5 + 1)), replace=False))
        x, y = sorted((np.sort(x), y), key=len)
        if len(np.intersect1d(x, y)) * 100 >= percent * len(np.union1d(x, y)):
            assert np.intersect1d(x[: J.first_ones(len(x), percent)[0]], y[: J.first_ones(len(y), percent)[1]]).size


@pytest.mark.parametrize(("kind", "make"), [("string", lambda i: f"doc {i:03d}"), ("decimal(9,2)", lambda i: Decimal(i) + Decimal("0.5"))])
def test_ids_of_any_type(spark, kind, make):
    text = "one two three four five six seven eight nine ten eleven"
    rows = [(make(i), t) for i, t in ((9, text), (3, text), (5, text + " twelve"), (7, "other words"), (8, ""), (9, text))] + [(None, text)]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").withColumn("number", F.lit(1))
    got = {r.doc_id: r for r in J.join(df, 90, 3).collect()}
    assert got[make(9)].class_id == make(3) and got[make(5)].component_id == make(3) and got[make(7)].component_id == make(7)
    assert [got[make(i)].n_links for i in (3, 5, 7, 8, 9)] == [2, 2, 0, 0, 2] and got[None].component_id is None
    if kind == "string":
        assert [(r.a, r.b) for r in J.pairs(df, 90, 3).collect()] == [(make(3), make(5))]
