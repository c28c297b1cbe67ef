"""Near-duplicate embeddings by counting collisions of many sorted one-dimensional projections.

A table is one random projection, by which vectors are sorted and each looks at a window around itself, inside a cell
of `strips` further projections cut into wide strips at random offsets. Windows alone would let a tenth of all
pairs collide in every table, whatever their number; the cells, more of them for more vectors, keep the
chance collisions of a vector in a table under 1 / SPARE. A pair is looked at closely if it collides in LEAST tables;
plan() takes as many tables as let a pair that is exactly as near as asked miss that with a chance of `miss`.

Pairs never become rows. Equal vectors of a label are one class with a number of members. A cell of one class makes no pairs; classes of other cells meet
in groups, in which a window slides over the sorted projection in numpy. From the keys and projections of both
vectors a group itself counts in how many tables they collide, and takes the pair only if its own table is the first of these,
so every pair counts once. Near ones are verified by cosine in double precision; the group gives only sums of links, and
one edge for each linked class. Cells of more than CHUNK classes are dealt into chunks, every two of which are a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, prepared, staged
from .components import components
from .hashing import U, mix

#: Tables in which a pair must collide, and one in how many cells a class shares by chance.
LEAST, SPARE = 2, 16
#: A strip and half a window, in the distance of vectors that are just near enough.
STRIP, WINDOW = 10, 2
#: Classes of a chunk, rows that are looked at together, and pairs of them.
CHUNK, ROWS, PAIRS = 512, 4096, 1 << 14
SEED = 20240101


class Plan(NamedTuple):
    cosine: float
    tables: int
    strips: int
    strip: float
    window: float


def _same_strip(apart: float, strip: float) -> float:
    """The chance that two points whose projections differ by N(0, apart²) fall into one strip of random offset."""
    t = strip / apart
    return math.erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))


def missed(p: float, tables: int) -> float:
    """The chance of fewer than LEAST collisions in so many tables."""
    return sum(math.comb(tables, k) * p**k * (1 - p) ** (tables - k) for k in range(LEAST))


def plan(cosine: float, vectors: int, miss: float) -> Plan:
    """Strips and tables for so many vectors of one label, taken as orthogonal where they aren't near."""
    if not 0 < cosine < 1:
        raise ValueError("cosine must lie between 0 and 1")
    near = math.sqrt(2 - 2 * cosine)
    strip, window = STRIP * near, WINDOW * near
    strips = max(1, math.ceil(math.log(SPARE * max(vectors, 2)) / -math.log(_same_strip(math.sqrt(2), strip))))
    p = _same_strip(near, strip) ** strips * math.erf(WINDOW / math.sqrt(2))
    tables = LEAST
    while missed(p, tables) > miss:
        tables += 1
    return Plan(cosine, tables, strips, strip, window)


@lru_cache(maxsize=8)
def _projections(dim: int, tables: int, strips: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    draw = np.random.default_rng([SEED, dim])
    return draw.standard_normal((dim, tables * strips)), draw.random(tables * strips), draw.standard_normal((dim, tables))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, of length 1."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _signed(plan: Plan):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            vectors = batch.column("embedding").to_pylist()
            dims = np.array([len(v) for v in vectors])
            keys, values, raw = [b""] * len(vectors), [b""] * len(vectors), [b""] * len(vectors)
            for dim in np.unique(dims):
                which = np.flatnonzero(dims == dim)
                x = unit(np.array([vectors[i] for i in which], np.float64))
                cuts, offsets, lines = _projections(int(dim), plan.tables, plan.strips)
                strips = np.floor((x @ cuts) / plan.strip + offsets).astype(np.int64).view(U).reshape(len(which), plan.tables, plan.strips)
                odd = mix(np.arange(plan.strips, dtype=U) + U(1)) | U(1)
                key = (mix((strips * odd).sum(axis=2, dtype=U)) >> U(32)).astype(np.uint32).view(np.int32)
                value = (x @ lines).astype(np.float32)
                for row, i in enumerate(which):
                    keys[i], values[i], raw[i] = key[row].tolist(), value[row].tolist(), x[row].tobytes()
            columns = [batch.column("node"), batch.column("label"), batch.column("held"), pa.array(dims, pa.int32()), pa.array(keys, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32())), pa.array(raw, pa.binary())]
            yield pa.record_batch(columns, names=["node", "label", "held", "dim", "keys", "vals", "vector"])

    return run


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _pairs_of(group: np.ndarray, value: np.ndarray, window: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of rows sorted by group and value, the pairs (a, b) of one group whose values are within the window, PAIRS or more at once."""
    left, step, first, second, held = np.arange(len(group)), 1, [], [], 0
    while len(left):
        left = left[left + step < len(group)]
        left = left[(group[left] == group[left + step]) & (value[left + step] - value[left] <= window)]
        first.append(left)
        second.append(left + step)
        held, step = held + len(left), step + 1
        if held >= PAIRS:
            yield np.concatenate(first), np.concatenate(second)
            first, second, held = [], [], 0
    if held:
        yield np.concatenate(first), np.concatenate(second)


def _links(rows: pa.Table, group: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by group and value, by node: links that are counted here, and a node that it hangs together with."""
    n = rows.num_rows
    node, held, t, own = (rows[c].to_numpy() for c in ("node", "held", "t", "own"))
    label = rows["label"].combine_chunks().dictionary_encode().indices.to_numpy()
    keys, vals = _matrix(rows["keys"], n), _matrix(rows["vals"], n)
    x = np.frombuffer(b"".join(rows["vector"].to_pylist()), np.float64).reshape(n, -1)
    window, across = np.float32(plan.window), rows["i"].to_numpy() != rows["j"].to_numpy()
    count, root = np.zeros(n, np.int64), np.arange(n)
    ends = []
    for a, b in _pairs_of(group, vals[np.arange(n), t], window):
        meet = (~across[a] | (own[a] != own[b])) & (label[a] == label[b])
        a, b = a[meet], b[meet]
        same = (keys[a] == keys[b]) & (np.abs(vals[a] - vals[b]) <= window)
        ours = (same.argmax(axis=1) == t[a]) & (same.sum(axis=1) >= LEAST) if len(a) else np.zeros(0, bool)
        a, b = a[ours], b[ours]
        near = np.einsum("ij,ij->i", x[a], x[b]) >= plan.cosine
        ends.append((a[near], b[near]))
        np.add.at(count, ends[-1][0], held[ends[-1][1]])
        np.add.at(count, ends[-1][1], held[ends[-1][0]])
    a, b = (np.concatenate([e[k] for e in ends] or [np.empty(0, np.int64)]) for k in (0, 1))
    while True:
        low, last = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == last).all():
            break
    some = np.flatnonzero(count)
    return node[some], count[some], node[root[some]]


def _compared(plan: Plan):
    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        dims = rows["dim"].to_numpy()
        for dim in np.unique(dims):
            part = rows.filter(pa.array(dims == dim))
            names = ("cell", "i", "j")
            change = np.zeros(part.num_rows, bool)
            for c in names:
                change[1:] |= np.diff(part[c].to_numpy()) != 0
            columns = _links(part, np.cumsum(change), plan)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["node", "n", "root"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in it:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) < ROWS:
                continue
            rows = pa.Table.from_batches(waiting)
            last = np.ones(rows.num_rows, bool)
            for c in ("cell", "i", "j"):
                x = rows[c].to_numpy()
                last &= x == x[-1]
            whole = rows.num_rows - int(last[::-1].cumprod().sum())  # the last group may go on in the next batch
            if whole:
                yield from found(rows.slice(0, whole))
                waiting = rows.slice(whole).to_batches()
        if waiting:
            yield from found(pa.Table.from_batches(waiting))

    return run


def link(vectors: DataFrame, cosine: float = 0.98, miss: float = 1e-4) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors (vec_id, embedding, label).

    Vectors of one label, not null, and of one length link if their cosine in double precision is `cosine` or more; no pair
    below it links, and each that is as near is found but with a chance of `miss`. n_links is the number of other ids with
    a linked vector; component_id the smallest id that links reach, itself included; kept whether that is its own.
    Vectors that are null, empty or zero, or hold a null or a non-finite component, and rows with a null label or id, link with
    nothing: no links, their own id, kept. Rows that repeat an id and a vector count as one vector; different vectors of an
    id count each by itself. Ids and labels may be of any type that can be ordered. An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    prepared(spark)
    key = ["label", "h1", "h2"]
    sound = F.expr("vec_id IS NOT NULL AND label IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)")
    rows = vectors.select("vec_id", "embedding", "label").withColumn("sound", F.coalesce(sound, F.lit(False)))
    rows = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    light = staged(rows.drop("embedding"), "vectors")
    known = rows.where("sound")
    sizes = light.where("sound").groupBy(key).agg(F.min("vec_id").alias("least"), F.countDistinct("vec_id").alias("held"))
    once = known.groupBy(key).agg(F.first("embedding").alias("embedding"))
    classes = staged(sizes.join(once, key).withColumn("node", F.monotonically_increasing_id()), "classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    p = plan(cosine, most, miss)
    named = classes.select("node", F.col("label").cast("string").alias("label"), "held", "embedding")
    signed = staged(named.mapInArrow(_signed(p), "node bigint, label string, held bigint, dim int, keys array<int>, vals array<float>, vector binary"), "signed")

    each = signed.select("node", "label", "dim", F.posexplode("keys").alias("t", "key")).select("node", "t", F.xxhash64("label", "dim", "t", "key").alias("cell"))
    shared = each.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
    each = hot_join(each, shared, ["cell"]).withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
    each = each.withColumn("own", F.pmod(F.xxhash64("node"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = each.select("node", "cell", "t", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    group = ["cell", "i", "j"]
    groups = dealt.join(signed, "node").withColumn("value", F.element_at("vals", F.col("t") + 1)).repartition(*group).sortWithinPartitions(*group, "value")
    found = staged(groups.select(*group, "t", "own", "node", "label", "held", "dim", "keys", "vals", "vector").mapInArrow(_compared(p), "node bigint, n bigint, root bigint"), "linked")

    counts = found.groupBy("node").agg(F.sum("n").alias("far"))
    reach = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    members = staged(classes.select("node", "least").join(reach, "node"), "members")
    ids = hot_join(members, members.groupBy("component").agg(F.min("least").alias("component_id")), ["component"]).select("node", "component_id")
    known = classes.select(*key, "node", "least", "held").join(counts, "node", "left").join(ids, "node", "left")
    known = known.select(*key, (F.col("held") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    linked = hot_join(light.where("sound"), known, key).select("vec_id", "n_links", "component_id")
    out = linked.unionByName(light.where("NOT sound").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: The same rows in DuckDB by comparing all pairs.
LINK_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98),
r(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a) USING (vec_id)
"""
