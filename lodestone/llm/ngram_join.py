"""Exact Jaccard self-join of documents on word shingles by PartEnum signatures, as connected components.

Sets are grouped by size into bands [l, r] with r = l / threshold, so two similar sets lie in one band or in
neighbouring ones, and an instance of the scheme for each pair of neighbouring bands covers them all. Within
an instance, similar sets differ in at most k elements, k following from the band's largest size. The domain
of shingle hashes is cut into partitions, each of them into cells (cells_of), and every choice of all cells but K2
of a partition gives a signature: the hash of what the set has there. A partition that holds at most K2 of the
differences has such a choice without any, so the sets share its signature; k // (K2 + 1) partitions can hold more.

There are more partitions than that and one (an eighth), and sets smaller than the band's end differ in less, so of a
set's partitions several must agree: `sure` + 1. A set may therefore leave out signatures of cells with fewer than
c elements, where c is the most with which at most `sure` partitions lose any: what agrees holds the same elements in
both sets, so of those `sure` + 1 one is left that both sets keep. So empty or nearly empty cells, which unlike sets
share by chance, make no pairs, and no similar pair is lost.

A second stage keeps a parity sketch of each set (a bit for each hash slot, flipped by every element in it).
Bits in which two sketches differ are never more than the elements in which the sets differ, so the sketch
rejects most pairs that merely share a signature, and never a similar one. Sketches are folded to LEAST_BITS bits for the
join by signature; the distinct pairs that it leaves are looked at by their whole sketches.

Equal sets form a class, and only its representative goes on. Signatures are made twice: once to count which of them
stand for more than one set (SIG_BITS bits of each travel, and no more), and again to write only those, by a bit filter
with FILTER_SLOTS bits for each shared signature; most sets have none. Beyond MOST_FILTER bits the filter lets more
through than are shared, which the join with the shared ones sorts out.

Groups of copies do not become pairs:

1. In every signature's group all members are compared with one hub only, the member whose signatures are
   the most common. Members whose similarity with it holds are connected, whatever their number.
2. Pairs of a group are then compared only across the components that this gives, and only those which pass the
   sketches leave the join. So all links between different components are found, exactly.
3. Where more than FEW members are left in such a group, as of many pages with one template that are just not similar, they
   meet by rare shingles instead: with all shingles in one order, the first that two similar sets share is among
   the first size - 2t / (1 + t) size + 1 of the smaller and the first size - t size + 1 of the larger (t the
   threshold). Any order is exact; it is by counts in ORDER_SLOTS slots, rare ones first, so pages of one template meet only if their
   own parts do. Shingles that many sets have among their first are dealt in chunks.

Joins by a class, a signature or a hub go by hot_join(), which deals keys with many rows by broadcast.

So the components are known. All links themselves, those inside a component too, are counted by join() and given by
pairs(): they can only lie inside components, so the classes of a component are dealt into chunks by hash, every pair of
chunks is one group, and a group counts the shared shingles of all its pairs at once. No group grows with the component;
the work does, with the square of the number of different near copies. Large components in which rare shingles leave far fewer pairs,
such as long chains, are linked by these.

Similarity is always decided on whole sets of 64-bit shingle hashes, made again from the two texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, prepared, staged
from .components import components
from .hashing import U, batches, grams, mix, words_of

#: Differences that a signature's partition stands (signatures() relies on its being 1), and the share of partitions (one in so many) beyond those needed.
K2, SPARE = 1, 8
#: Bits of a signature that are compared; equal ones by chance only add candidates.
SIG_BITS = 48
#: Up to so many ids (16 MB) are broadcast to pick the texts that are compared; more are joined.
MOST_BROADCAST = 2_000_000
#: Least bits of a parity sketch, and its words of 64 bits when it is folded to that.
LEAST_BITS, FOLDED = 512, 8
#: Bits of the filter for each shared signature, and at most: 32 MB.
FILTER_SLOTS, MOST_FILTER = 16, 1 << 28
#: Members of a signature's group that are compared each with each, and slots by whose counts shingles are ordered (a byte each is broadcast).
FEW, ORDER_SLOTS = 32, 1 << 22
#: Sets of a chunk that meet by one rare shingle.
RARE_CHUNK = 1024
#: Classes from which on a component may be linked by rare shingles, if these leave less than one in SPARSE of its pairs.
LARGE, SPARSE = 512, 8
#: Classes of a chunk, about, and shingles that a group's pairs are counted over at once.
CHUNK, AT_ONCE = 64, 1 << 16


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Of each text, the sorted distinct hashes of its n-word shingles; with fewer words, of all words as one."""
    w = words_of(texts)
    h, at = grams(w, n)
    edge = np.searchsorted(w.text[at], np.arange(len(texts) + 1))
    out = []
    for k in range(len(texts)):
        if edge[k] < edge[k + 1]:
            out.append(np.unique(h[edge[k] : edge[k + 1]]))
        else:
            s = w.hash[w.first[k] : w.first[k + 1]]
            x = U(len(s) + 0x51ED27)
            for v in s:
                x = mix(np.array([x]) * U(0xA0761D6478BD642F) + v)[0]
            out.append(np.array([x] if len(s) else [], U))
    return out


def bands(largest: int, percent: int) -> np.ndarray:
    """The largest size of each band, from the first on until one holds `largest`."""
    out, low = [0], 1
    while out[-1] < largest:
        out.append(low * 100 // percent)
        low = out[-1] + 1
    return np.array(out)


def differences(size_sum: int, percent: int) -> int:
    """The most elements in which similar sets of these sizes together differ."""
    return size_sum * (100 - percent) // (100 + percent)


def cells_of(partitions: int) -> int:
    """Cells of a partition. Small sets have few partitions and afford more cells, which they need."""
    return 4 if partitions <= 3 else 3


@lru_cache(maxsize=4096)
def _instance(i: int, end: int, percent: int) -> tuple[int, int, np.uint64, np.ndarray, np.ndarray]:
    """Of the instance of band i: partitions, cells of each, seed, and what is added to cells and to signatures before they are mixed."""
    k = differences(2 * end, percent)
    need = k // (K2 + 1) + 1
    n1, n2 = (need + need // SPARE, cells_of(need)) if k >= K2 else (1, 1)
    seed = U(0x9E3779B97F4A7C15 * (2 * i + 1) & 0xFFFFFFFFFFFFFFFF)
    offsets = np.arange(n1 * n2, dtype=U).reshape(n1, n2) * U(0xD6E8FEB86659FD93)
    salts = (np.arange(n1, dtype=U)[:, None] * U(64) + np.arange(n2, dtype=U)) * U(0xBF58476D1CE4E5B9) + seed
    return n1, n2, seed, offsets, salts


def signatures(s: np.ndarray, percent: int, ends: np.ndarray) -> np.ndarray:
    """The signatures of one set: those of the instance that its band ends, and of the next one.

    As K2 is 1, a choice of cells is a partition without one of them, so its sums are those of the partition less the cell's.
    """
    out = []
    band = int(np.searchsorted(ends, len(s)))
    for i in (band, band + 1):
        end = int(ends[i])
        n1, n2, seed, offsets, salts = _instance(i, end, percent)
        if n2 == 1:  # similar sets are equal sets
            out.append(mix(mix(mix(s + seed).sum(dtype=U, keepdims=True)) ^ salts[0]))
            continue
        cell = (((mix(s ^ seed) >> U(32)) * U(n1 * n2)) >> U(32)).astype(np.int64)
        sums = np.zeros(n1 * n2, U)
        np.add.at(sums, cell, mix(s + seed))
        sums = mix(sums.reshape(n1, n2) + offsets)
        held = np.bincount(cell, minlength=n1 * n2).reshape(n1, n2)
        content = held.sum(axis=1, keepdims=True) - held
        most = differences(len(s) + min(end, len(s) * 100 // percent), percent)
        sure = n1 - 1 - most // (K2 + 1)
        least = np.partition(content.min(axis=1), sure)[sure]
        out.append(mix(sums.sum(axis=1, dtype=U, keepdims=True) - sums ^ salts)[content >= least])
    return np.concatenate(out) >> U(64 - SIG_BITS)


def parity(s: np.ndarray) -> np.ndarray:
    """The sketch's bits as 64-bit words, least ones first: LEAST_BITS, or the power of two from the size on."""
    bits = max(LEAST_BITS, 1 << int(len(s) - 1).bit_length())
    odd = np.bincount((mix(s ^ U(0x5851F42D4C957F2D)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def folded(words: np.ndarray) -> np.ndarray:
    """The sketch of LEAST_BITS bits that a longer one folds to."""
    return np.bitwise_xor.reduce(words.reshape(-1, FOLDED), axis=0)


def _signed(percent: int, n: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = bands(1 << 32, percent)
        for batch in it:
            for _, texts in batches(batch.column(0).to_pylist()):
                sigs = [signatures(s, percent, ends) for s in shingle_sets(texts, n) if len(s)]
                yield pa.record_batch([pa.array(np.concatenate([*sigs, np.empty(0, U)]).view(np.int64))], names=["sig"])

    return run


def _sized(n: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at, texts in batches(batch.column(1).to_pylist()):
                sets = shingle_sets(texts, n)
                found = [[len(s) for s in sets], *zip(*map(set_hash, sets))]
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), *[pa.array(x, pa.int64()) for x in found]], names=["doc_id", "size", "h1", "h2"])

    return run


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits that, with the size, stand for the set."""
    return int(mix(s).sum(dtype=U).astype(np.int64)), int(mix(s ^ U(0x2545F4914F6CDD1D)).sum(dtype=U).astype(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = pa.array(np.cumsum([0] + [len(x) for x in arrays]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*arrays, np.empty(0, np.int64)])))


def _sketched(percent: int, n: int, filled):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, bitmap = bands(1 << 32, percent), filled.value
        mask = U(64 * len(bitmap) - 1)
        for batch in it:
            for at, texts in batches(batch.column(1).to_pylist()):
                which, size, h1, h2, sigs, bits, fold = [], [], [], [], [], [], []
                for i, s in enumerate(shingle_sets(texts, n)):
                    x = signatures(s, percent, ends) if len(s) else np.empty(0, U)
                    slot = (x & mask).astype(np.int64)
                    x = x[bitmap[slot >> 6] >> (slot & 63).astype(U) & U(1) == 1]
                    if len(x):
                        which.append(at + i)
                        size.append(len(s))
                        h1.append(set_hash(s)[0])
                        h2.append(set_hash(s)[1])
                        sigs.append(x.view(np.int64))
                        bits.append(parity(s))
                        fold.append(folded(bits[-1]))
                numbers = [pa.array(x, pa.int64()) for x in (size, h1, h2)]
                ids = batch.column(0).take(pa.array(which, pa.int64()))
                yield pa.record_batch([ids, *numbers, _lists(sigs), _lists(bits), _lists(fold)], names=["doc_id", "size", "h1", "h2", "sigs", "bits", "fold"])

    return run


def _bitmap(common: DataFrame) -> np.ndarray:
    """A bit for each slot of a signature, FILTER_SLOTS for each in `common`: at most MOST_FILTER bits come to the driver."""
    slots = min(MOST_FILTER, max(1 << 12, 1 << (FILTER_SLOTS * common.count()).bit_length()))
    slot = F.col("sig").bitwiseAND(slots - 1)
    words = common.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, CAST(sig & 63L AS INT))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(slots >> 6, np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.view(U)


def _verified(percent: int, n: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            last: dict[bytes, np.ndarray] = {}
            keep, counts = [], []
            for i in range(len(a)):
                both = []
                for t in (ta[i], tb[i]):
                    if t not in last:
                        if len(last) > 200:
                            last.clear()
                        last[t] = shingle_sets([t], n)[0]
                    both.append(last[t])
                x, y = both
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
                counts.append(shared)
            out = pa.record_batch([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["a", "b", "n_shared"])
            yield out.filter(pa.array(keep, pa.bool_()))

    return run


def _most(percent: int) -> Column:
    return F.floor((F.col("x.size") + F.col("y.size")) * (100 - percent) / (100 + percent))


def may_link(percent: int) -> Column:
    """Whether two sets x and y, by (size, w0, w1, ..), may be similar: their sizes allow it, and their folded sketches do.

    This is what every pair that shares a signature is asked, so it is plain arithmetic, compiled with the join.
    """
    apart = F.expr(" + ".join(f"bit_count(x.w{k} ^ y.w{k})" for k in range(FOLDED)))
    return (F.least("x.size", "y.size") * 100 >= F.greatest("x.size", "y.size") * percent) & (apart <= _most(percent))


def still_may_link(percent: int) -> Column:
    """Whether two sets x and y, by (size, bits), may be similar by their whole sketches.

    Sizes that may be similar differ by less than the half, so one sketch has at most twice the other's words;
    its halves are folded, which gives the sketch of half the slots.
    """
    shrunk = "CASE WHEN size({0}.bits) > size({1}.bits) THEN zip_with(slice({0}.bits, 1, size({1}.bits)), slice({0}.bits, size({1}.bits) + 1, size({1}.bits)), (p, q) -> p ^ q) ELSE {0}.bits END"
    apart = F.expr(f"aggregate(zip_with({shrunk.format('x', 'y')}, {shrunk.format('y', 'x')}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)")
    return F.coalesce(apart <= _most(percent), F.lit(True))


def links(pairs: DataFrame, sketch: DataFrame, docs: DataFrame, percent: int, n: int) -> DataFrame:
    """Of pairs (a, b) of ids, the pairs whose texts' sets are similar, with their shared shingles: by their whole sketches, then by the texts."""
    x, y = (sketch.select(F.col("doc_id").alias(c), F.struct("size", "bits").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    return verified(pairs.join(x, "a").join(y, "b").where(still_may_link(percent)).select("a", "b"), docs, percent, n)


def verified(pairs: DataFrame, docs: DataFrame, percent: int, n: int) -> DataFrame:
    """(a, b, n_shared) of the pairs (a, b) of ids whose texts' sets are similar."""
    pairs = staged(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ids = F.broadcast(ids) if pairs.count() * 2 <= MOST_BROADCAST else ids
    texts = docs.join(ids, "doc_id", "left_semi")
    a, b = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    return staged(both.mapInArrow(_verified(percent, n), "a bigint, b bigint, n_shared bigint"), "links")


def first_ones(size: int, percent: int) -> tuple[int, int]:
    """How many of a set's first shingles are looked at if it is the smaller of two similar sets, and if it is the larger."""
    return size + (-2 * percent * size) // (100 + percent) + 1, size + (-percent * size) // 100 + 1


def _counted(n: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(ORDER_SLOTS, np.int64)
        for batch in it:
            for _, texts in batches(batch.column(0).to_pylist()):
                for s in shingle_sets(texts, n):
                    np.add.at(count, (mix(s) & U(ORDER_SLOTS - 1)).astype(np.int64), 1)
        some = np.flatnonzero(count)
        yield pa.record_batch([pa.array(some), pa.array(count[some])], names=["slot", "n"])

    return run


def _order(texts: DataFrame, n: int) -> np.ndarray:
    """The magnitude of each slot's count, a byte a slot: half of an octave's logarithm."""
    counts = texts.select("text").mapInArrow(_counted(n), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    level = F.expr("shiftleft(CAST(floor(2 * log2(n)) AS BIGINT) + 1, CAST(slot % 8 * 8 AS INT))")
    packed = counts.groupBy(F.shiftright("slot", 3).alias("word")).agg(F.bit_or(level).alias("levels")).toArrow()
    out = np.zeros(ORDER_SLOTS >> 3, np.int64)
    out[packed["word"].to_numpy()] = packed["levels"].to_numpy()
    return out.view(np.uint8)


def _rarest(percent: int, n: int, order):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = order.value
        for batch in it:
            for at, texts in batches(batch.column(1).to_pylist()):
                which, sizes, firsts, rare = [], [], [], []
                for i, s in enumerate(shingle_sets(texts, n)):
                    if len(s):
                        least, most = first_ones(len(s), percent)
                        which.append(at + i)
                        sizes.append(len(s))
                        firsts.append(least)
                        rare.append(s[np.lexsort((s, levels[(mix(s) & U(ORDER_SLOTS - 1)).astype(np.int64)]))[:most]].view(np.int64))
                ids = batch.column(0).take(pa.array(which, pa.int64()))
                yield pa.record_batch([ids, pa.array(sizes, pa.int64()), pa.array(firsts, pa.int64()), _lists(rare)], names=["doc_id", "size", "first", "rare"])

    return run


def rarest(texts: DataFrame, percent: int, n: int) -> DataFrame:
    """(doc_id, size, first, rare) of texts (doc_id, text): each set's first shingles in an order that they all have in common, rare ones first."""
    order = texts.sparkSession.sparkContext.broadcast(_order(texts, n))
    out = staged(texts.select("doc_id", "text").mapInArrow(_rarest(percent, n, order), "doc_id bigint, size bigint, first bigint, rare array<bigint>"), "rarest")
    order.destroy()
    return out


def rare_pairs(rare: DataFrame, group: str, percent: int, inside: bool) -> DataFrame:
    """Distinct pairs (a, b), a < b, of ids of rarest() whose sets may be similar, of one `group` (a column of rare) or of different ones.

    rare must be a written table, it is read several times. With folded sketches (w0, w1, ..) in it, these must allow a pair too, and
    are asked inside the join.
    """
    words = [c for c in rare.columns if c in {f"w{k}" for k in range(FOLDED)}]
    larger = rare.select("doc_id", "size", group, *words, F.explode("rare").alias("h"))
    smaller = rare.select("doc_id", "size", group, *words, F.explode(F.slice("rare", F.lit(1), F.col("first").cast("int"))).alias("h"))
    many = staged(larger.groupBy("h").count().where(F.col("count") > RARE_CHUNK).select("h", F.ceil(F.col("count") / RARE_CHUNK).cast("int").alias("chunks")), "many")
    if many.isEmpty():
        larger, smaller = (x.withColumn("chunk", F.lit(0)) for x in (larger, smaller))
    else:
        larger = hot_join(larger, many, ["h"], "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("doc_id"), "chunks").cast("int"), F.lit(0)))
        smaller = hot_join(smaller, many, ["h"], "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
    x, y = smaller.alias("x"), larger.alias("y")
    same = F.col(f"x.{group}") == F.col(f"y.{group}")
    before = (F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.doc_id") < F.col("y.doc_id")))
    near = (F.col("x.size") * 100 >= F.col("y.size") * percent) & (F.col("x.doc_id") != F.col("y.doc_id"))
    near = near & may_link(percent) if words else near
    both = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.chunk") == F.col("y.chunk")) & before & near & (same if inside else ~same))
    return both.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def _representatives(docs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Of docs, one row for every different text of an id that represents a class, and few others."""
    spare = rows.select("doc_id").subtract(classes.select(F.col("class_id").alias("doc_id")))
    spare = staged(spare.where("doc_id IS NOT NULL"), "spare")
    spare = F.broadcast(spare) if spare.count() <= MOST_BROADCAST else spare
    docs = docs.where("doc_id IS NOT NULL").join(spare, "doc_id", "left_anti")
    again = rows.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1").select("doc_id")
    if again.isEmpty():
        return docs
    return docs.join(again, "doc_id", "left_anti").unionByName(docs.join(again, "doc_id", "left_semi").distinct())


def _found(docs: DataFrame, percent: int, n: int) -> DataFrame:
    """The rows of join() without n_links, and the set: size, h1, h2, class and component null without a set or an id."""
    prepared(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = staged(docs.mapInArrow(_sized(n), "doc_id bigint, size bigint, h1 bigint, h2 bigint"), "sets")
    known = rows.where("doc_id IS NOT NULL AND size > 0")
    key = ["size", "h1", "h2"]
    classes = staged(known.groupBy(key).agg(F.min("doc_id").alias("class_id")), "classes")
    texts = _representatives(docs, rows, classes)
    every = texts.select("text").mapInArrow(_signed(percent, n), "sig bigint")
    common = staged(every.groupBy("sig").count().where("count > 1").select("sig"), "common")
    filled = spark.sparkContext.broadcast(_bitmap(common))
    sketched = staged(texts.mapInArrow(_sketched(percent, n, filled), "doc_id bigint, size bigint, h1 bigint, h2 bigint, sigs array<bigint>, bits array<bigint>, fold array<bigint>"), "sketches")
    filled.destroy()  # what it was for is written
    once = sketched.join(classes, key).groupBy("class_id", "size").agg(F.first("bits").alias("bits"), F.first("fold").alias("fold"))
    sketch = staged(once.select(F.col("class_id").alias("doc_id"), "size", "bits", *[F.col("fold")[k].alias(f"w{k}") for k in range(FOLDED)]), "sketch")
    quick = sketch.drop("bits")

    each = sketched.select(*key, F.explode("sigs").alias("sig")).distinct().join(classes, key).select("sig", F.col("class_id").alias("doc_id"))
    members = staged(each.join(common, "sig", "left_semi"), "members")
    counts = staged(members.groupBy("sig").count().where("count > 1"), "counts")
    groups = staged(hot_join(members, counts, ["sig"]), "groups")
    fame = groups.groupBy("doc_id").agg(F.sum("count").alias("fame"))
    famous = staged(groups.join(fame, "doc_id").select("sig", "doc_id", "fame"), "famous")
    hubs = famous.groupBy("sig").agg(F.max_by("doc_id", F.struct("fame", "doc_id")).alias("hub"))
    stars = staged(hot_join(famous, hubs, ["sig"]).where("doc_id <> hub").select("doc_id", "hub").distinct(), "spokes")
    stars = hot_join(stars, quick.select(F.col("doc_id").alias("hub"), F.struct(*quick.columns[1:]).alias("y")), ["hub"])
    stars = stars.alias("s").join(quick.alias("x"), (F.col("s.doc_id") == F.col("x.doc_id")) & may_link(percent))
    stars = staged(stars.select(F.least("s.doc_id", "s.hub").alias("a"), F.greatest("s.doc_id", "s.hub").alias("b")).distinct(), "stars")
    docs = docs.where("doc_id IS NOT NULL")
    near = links(stars, sketch, docs, percent, n)

    # Of every member, the component that the links with hubs give it; then the pairs of a group across components.
    led = groups.join(components(near), F.col("doc_id") == F.col("node"), "left").select("sig", "doc_id", F.coalesce("component", "doc_id").alias("hub"))
    led = staged(led, "led")
    split = led.groupBy("sig").agg(F.min("hub").alias("x"), F.max("hub").alias("y"), F.count("*").alias("n")).where("x < y").select("sig", "n")
    split = staged(split, "split")
    led = staged(hot_join(led, split, ["sig"]), "parted")
    left = staged(led.where(F.col("n") <= FEW).drop("n").join(quick, "doc_id"), "left")
    x, y = left.alias("x"), left.alias("y")
    more = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.hub") != F.col("y.hub")) & may_link(percent))
    more = more.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    if not split.where(F.col("n") > FEW).isEmpty():
        crowd = staged(led.where(F.col("n") > FEW).select("doc_id", "hub").distinct(), "crowd")
        rare = rarest(docs.join(crowd, "doc_id", "left_semi"), percent, n).join(crowd, "doc_id").join(quick, ["doc_id", "size"])
        more = more.unionByName(rare_pairs(staged(rare, "rare"), "hub", percent, False))
    more = more.distinct().join(stars, ["a", "b"], "left_anti")
    far = links(more, sketch, docs, percent, n)

    found = staged(hot_join(known, classes, key).unionByName(rows.where("doc_id IS NULL OR size = 0").withColumn("class_id", F.lit(None).cast("bigint"))), "classed")
    several = rows.groupBy("doc_id").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("doc_id")
    same_id = found.join(several, "doc_id", "left_semi").where("class_id IS NOT NULL").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    reach = components(near.unionByName(far).select("a", "b").unionByName(same_id)).withColumnRenamed("node", "class_id")
    known, blank = found.where("class_id IS NOT NULL"), found.where("class_id IS NULL")
    known = hot_join(known, reach, ["class_id"], "left").withColumn("component", F.coalesce("component", "class_id"))
    return known.unionByName(blank.withColumn("component", F.lit(None).cast("bigint")))


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs with ids that are numbers, in the ids' order, and which id has which (doc_id, number); whole numbers stay as they are."""
    if dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint"):
        return docs, None
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ids = staged(ids.withColumn("number", F.monotonically_increasing_id()), "ids")
    return docs.select("doc_id", "text").join(ids, "doc_id", "left").select(F.col("number").alias("doc_id"), "text"), ids


def _named(found: DataFrame, ids: DataFrame | None, *columns: str) -> DataFrame:
    if ids is None:
        return found
    order = found.columns
    for c in columns:
        named = hot_join(staged(found, "numbered"), ids.select(F.col("number").alias(c), F.col("doc_id").alias("_named")), [c], "left")
        found = named.drop(c).withColumnRenamed("_named", c)
    return found.select(*order)


def join(docs: DataFrame, percent: int = 90, n: int = 3, count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, n_links), one row for each row of docs.

    Sets are the distinct n-word shingles of the whole text, A-Z lowered; with fewer than n words, the whole
    sequence as one; a null, empty or blank text has none and links with nothing. Two rows link when 100 times
    the shared shingles are at least `percent` times all. class_id is the smallest id with an equal set,
    component_id the smallest id that links reach; both are the row's own id without a set. n_links is the number
    of other ids that the row links with; an id with several texts counts for each of them. Rows that repeat
    an id count as one document where links are followed; rows with a null id link with nothing and have null
    class and component. Ids may be of any type that has an order. An empty table gives an empty result; other columns of docs are not read. Without
    count_links the last column is left out, and links inside components need not all be looked at.
    """
    docs, ids = _numbered(docs)
    found = _found(docs, percent, n)
    if count_links:
        found = staged(found, "found")
        held = staged(found.where("class_id IS NOT NULL").select("class_id", "doc_id").distinct().groupBy("class_id").count(), "held")
        far = _linked(docs, found, percent, n, True).groupBy("class_id").agg(F.sum("n").alias("far"))
        held = held.join(far, "class_id", "left").select("class_id", (F.col("count") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
        found = hot_join(found.where("class_id IS NOT NULL"), held, ["class_id"]).unionByName(found.where("class_id IS NULL").withColumn("n_links", F.lit(0).cast("bigint")))
    own = F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id")
    found = found.select("doc_id", F.col("size").alias("n_shingles"), *own, *(["n_links"] if count_links else []))
    return _named(found, ids, "doc_id", "class_id", "component_id")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The number of common elements of every two sets."""
    values = np.concatenate([*sets, np.empty(0, U)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    number = np.cumsum(np.diff(values, prepend=values[:1]) != 0)
    out = np.zeros((len(sets), len(sets)), np.int64)
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, AT_ONCE):
        x, y = np.searchsorted(number, [low, low + AT_ONCE])
        held = np.zeros((len(sets), int(number[y - 1]) - low + 1), np.float32)
        held[owner[x:y], number[x:y] - low] = 1
        out += (held @ held.T).astype(np.int64)
    return out


def _paired(percent: int, n: int, count: bool):
    def run(group: pa.Table) -> pa.Table:
        first, second = group["i"][0].as_py(), group["j"][0].as_py()
        known: dict[tuple[int, int], tuple[np.ndarray, int, int]] = {}
        ids, h1, own, held = (group[c].to_pylist() for c in ("doc_id", "h1", "own", "held"))
        for k, s in enumerate(shingle_sets(group["text"].to_pylist(), n)):
            if len(s) and set_hash(s)[0] == h1[k]:
                known[ids[k], h1[k]] = s, own[k], held[k]
        keys, sets, chunk = list(known), [s for s, *_ in known.values()], np.array([c for _, c, _ in known.values()])
        size, shared = np.array([len(s) for s in sets], np.int64), shared_counts(sets)
        linked = (shared > 0) & (100 * shared >= percent * (size[:, None] + size - shared))
        linked &= np.triu(chunk[:, None] != chunk if first != second else np.ones_like(linked), 1)
        if count:
            rows = np.array([h for *_, h in known.values()], np.int64)
            both = linked | linked.T
            some = np.flatnonzero(both.any(axis=1))
            return pa.table([pa.array([keys[i][0] for i in some], pa.int64()), pa.array((both @ rows)[some], pa.int64())], names=["class_id", "n"])
        pairs: dict[tuple[int, int], int] = {}
        for x, y in zip(*np.nonzero(linked)):
            if keys[x][0] != keys[y][0]:
                key = min(keys[x][0], keys[y][0]), max(keys[x][0], keys[y][0])
                pairs[key] = max(pairs.get(key, 0), int(shared[x, y]))
        columns = [[a for a, _ in pairs], [b for _, b in pairs], list(pairs.values())]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n_shared"])

    return run


def _linked(docs: DataFrame, found: DataFrame, percent: int, n: int, count: bool) -> DataFrame:
    """Of the classes of _found(): the rows of pairs(), or by class (class_id, n) counts of the ids in linked classes."""
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    held = found.where("class_id IS NOT NULL").groupBy("class_id", "size", "h1", "h2", "component").agg(F.countDistinct("doc_id").alias("held"))
    held = staged(held.select(F.col("class_id").alias("doc_id"), "h1", "component", "held"), "held")
    sizes = held.groupBy("component").agg(F.count("*").alias("size")).where("size > 1").withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
    thin = _thin(held, sizes.where(F.col("size") > LARGE).select("component", "size"), texts, percent, n)
    by_rare = None
    if thin is not None:
        rare, thin = thin
        sizes = sizes.join(thin, "component", "left_anti")
        by_rare = verified(rare_pairs(rare, "component", percent, True), texts, percent, n)
    dealt = hot_join(held, sizes, ["component"]).withColumn("own", F.pmod(F.xxhash64("doc_id"), "chunks").cast("int"))
    dealt = staged(dealt.select("component", "chunks", "doc_id", "h1", "own", "held"), "dealt")
    groups = dealt.join(texts, "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    groups = groups.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", "h1", "own", "held", "text")
    found = groups.groupBy("component", "i", "j").applyInArrow(_paired(percent, n, count), "class_id bigint, n bigint" if count else "a bigint, b bigint, n_shared bigint")
    if by_rare is None:
        return found
    if not count:
        return found.unionByName(by_rare)
    ends = by_rare.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select(F.col("e.a").alias("class_id"), F.col("e.b").alias("doc_id"))
    return found.unionByName(ends.join(held.select("doc_id", F.col("held").alias("n")), "doc_id").select("class_id", "n"))


def _thin(held: DataFrame, large: DataFrame, texts: DataFrame, percent: int, n: int) -> tuple[DataFrame, DataFrame] | None:
    """Of the large components, those in which rare shingles leave few pairs: (rarest() of their classes, their components).

    An id that stands for several classes keeps its component out.
    """
    large = staged(large, "large")
    if large.isEmpty():
        return None
    own = staged(hot_join(held, large, ["component"]).select("doc_id", "component"), "own")
    twice = own.groupBy("doc_id").count().where("count > 1").join(own, "doc_id").select("component").distinct()
    own = own.join(twice, "component", "left_anti")
    rare = staged(rarest(texts.join(own, "doc_id", "left_semi"), percent, n).join(own, "doc_id"), "rare")
    work = rare.select("component", F.explode("rare").alias("h")).groupBy("component", "h").count().groupBy("component").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("work"))
    thin = staged(work.join(large, "component").where(F.col("work") * SPARSE < F.col("size").cast("double") * F.col("size")).select("component"), "thin")
    if thin.isEmpty():
        return None
    return staged(rare.join(thin, "component", "left_semi"), "rare"), thin


def pairs(docs: DataFrame, percent: int = 90, n: int = 3) -> DataFrame:
    """(a, b, n_shared), one row for every two class representatives a < b that link, with their shared shingles.

    Sets, links and classes are those of join(): rows of one class link besides, so with the classes' sizes this
    gives each document's links. Of an id that is repeated with different texts, the pair that shares
    most counts. An empty table gives an empty result.
    """
    docs, ids = _numbered(docs)
    return _named(_linked(docs, staged(_found(docs, percent, n), "found"), percent, n, False), ids, "a", "b")


#: The same rows in DuckDB by comparing all pairs that share a shingle.
JOIN_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(words) - 1), lambda i: md5(words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) AS shingle FROM w WHERE len(words) >= 3
    UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, list(shingle ORDER BY shingle) AS l FROM s GROUP BY doc_id),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY l) AS class_id FROM c)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(k.class_id, w.doc_id) AS class_id, m.component_id, CAST(coalesce(f.n, 0) AS BIGINT) AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM e GROUP BY a) f USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""

#: All links between class representatives, by the same plain comparison.
PAIRS_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(words) - 1), lambda i: md5(words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) AS shingle FROM w WHERE len(words) >= 3
    UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT doc_id, list(shingle ORDER BY shingle) AS l FROM s GROUP BY doc_id),
k AS (SELECT min(doc_id) AS doc_id FROM c GROUP BY l),
t AS (SELECT s.* FROM s JOIN k USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT p.a, p.b, p.shared AS n_shared FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 90 * (x.n + y.n - shared)
"""
