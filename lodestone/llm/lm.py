"""Stupid-backoff language-model scores from n-gram counts of the whole corpus, computed relationally.

The relations are the documents' n-grams (orders 1 to ORDER, by 56-bit hash) and the count table, partitioned
by hash. Rows of single n-grams would be a dozen times the corpus, so both travel in blocks:

1. Pieces of a task's documents, packed, are dealt into chunks of about CHUNK_BYTES by a hash.
2. A chunk's distinct n-grams, sorted, are cut by the leading bits of their hash into blocks of (hash, count in
   the chunk), one for each partition of the count table; hashes are stored as differences.
3. A partition of the count table is the sum of its blocks. It answers each block with the total counts, in
   the block's order.
4. The answers meet their chunk's documents again, every word's score is looked up, and each document's summed.

Chunks and partitions have a fixed size, whatever the corpus's; their numbers grow with it. A frequent n-gram is
one entry of each block, so no partition is hot. Blocks are chunks times partitions; beyond 2**FAN_BITS chunks (160 GB) that
would be one for a few n-grams, so there chunks are cut by half of the bits first, and the blocks of as many chunks, summed,
by the other half: the number of blocks then grows as the corpus does, for one more way there and back. Scoring runs on whole
texts.

Every n-gram of a document is in the corpus, be it by that document alone. So besides the plain score there is one from the
counts of all other documents, which tells text that the corpus holds elsewhere from text that it does not.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import prepared
from .hashing import U, batches, grams, mix, words_of

ORDER = 3
ALPHA = 0.4
MIN_COUNT = 1
CHUNK_BYTES = 5 << 20
#: A chunk is cut into at most so many blocks, as a power of two.
FAN_BITS = 15
#: Bits of the n-gram hashes that are kept.
BITS = 56


def _sized(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n_bytes = n_words = 0
    for batch in it:
        for _, texts in batches(batch.column(0).to_pylist()):
            n_bytes += sum(map(len, texts))
            n_words += len(words_of(texts).hash)
    yield pa.record_batch([pa.array([n_bytes]), pa.array([n_words])], names=["n_bytes", "n_words"])


def _packed(n_chunks: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at, texts in batches(batch.column(1).to_pylist()):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(at, len(texts))]) for c in batch.columns], schema=batch.schema))
                pack = sink.getvalue().to_pybytes()
                yield pa.record_batch([pa.array([zlib.crc32(pack) % n_chunks]), pa.array([pack], pa.binary())], names=["chunk", "pack"])

    return run


def _unpacked(packs: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in sorted(packs["pack"].to_pylist())])


def _chunk_keys(texts: list[bytes], order: int) -> tuple[list, list[np.ndarray], np.ndarray]:
    """Of a chunk's texts: (words, n-gram starts by order) of its batches, the keys by batch and order, and all keys."""
    parsed, keys = [], []
    for _, batch in batches(texts):
        w = words_of(batch)
        starts = []
        for n in range(1, order + 1):
            h, at = grams(w, n)
            keys.append(mix(h + U(n)) >> U(64 - BITS))
            starts.append(at)
        parsed.append((w.text, w.first, starts))
    return parsed, keys, np.concatenate(keys) if keys else np.empty(0, U)


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences of the fewest whole bytes, and counts as bytes, those over 254 apart."""
    steps = np.diff(keys, prepend=U(0))
    size = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([size]) + len(keys).to_bytes(4, "little") + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :size]).tobytes() + _pack_counts(counts)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, n = data[0], int.from_bytes(data[1:5], "little")
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :size] = np.frombuffer(data, np.uint8, n * size, 5).reshape(n, size)
    return np.cumsum(steps.view(U).reshape(-1), dtype=U), _unpack_counts(data[5 + n * size :], n)


def _pack_counts(counts: np.ndarray) -> bytes:
    big = np.flatnonzero(counts > 254)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[big].astype(np.int64).tobytes()


def _unpack_counts(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, np.int64, -1, n) if len(data) > n else 0
    return counts


def _blocks(order: int, part_bits: int):
    def run(table: pa.Table) -> pa.Table:
        _, _, keys = _chunk_keys(_unpacked(table)["text"].to_pylist(), order)
        keys, counts = np.unique(keys, return_counts=True)
        edge = np.searchsorted(keys, np.arange((1 << part_bits) + 1, dtype=U) << U(BITS - part_bits))
        full = np.flatnonzero(edge[1:] > edge[:-1])
        blocks = [_pack(keys[edge[p] : edge[p + 1]] - (U(p) << U(BITS - part_bits)), counts[edge[p] : edge[p + 1]]) for p in full.tolist()]
        return pa.table({"chunk": pa.array([table["chunk"][0].as_py()] * len(full), pa.int64()), "part": pa.array(full, pa.int64()), "block": pa.array(blocks, pa.binary())})

    return run


def _together(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of blocks: the distinct keys, their summed counts, of each entry its key's number, and where each block's entries start."""
    both = [_unpack(b) for b in blocks]
    every, where = np.unique(np.concatenate([k for k, _ in both]), return_inverse=True)
    totals = np.bincount(where, np.concatenate([c for _, c in both]), len(every)).astype(np.int64)
    return every, totals, where, np.cumsum([0] + [len(k) for k, _ in both])


def _answer(counts: np.ndarray) -> bytes:
    return _pack_counts(counts) + len(counts).to_bytes(4, "little")


def _counts_of(answers: pa.Table) -> np.ndarray:
    """The counts of answers, in the order of their parts."""
    found = [a[:-4] for a in answers.sort_by("part")["answer"].to_pylist()]
    sizes = [int.from_bytes(a[-4:], "little") for a in answers.sort_by("part")["answer"].to_pylist()]
    return np.concatenate([np.empty(0, np.int64), *(_unpack_counts(a, n) for a, n in zip(found, sizes, strict=True))])


def _answers(table: pa.Table) -> pa.Table:
    """Sum a partition's blocks, and give each block's total counts."""
    _, totals, where, edge = _together(table["block"].to_pylist())
    found = [_answer(totals[where[a:b]]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return pa.table({"chunk": table["chunk"], "part": table["part"], "answer": pa.array(found, pa.binary())})


def _merged(fine_bits: int, key_bits: int):
    def run(table: pa.Table) -> pa.Table:
        """The blocks that a range of chunks has for one coarse part, summed and cut into fine parts."""
        keys, counts, _, _ = _together(table["block"].to_pylist())
        below = U(key_bits - fine_bits)
        edge = np.searchsorted(keys, np.arange((1 << fine_bits) + 1, dtype=U) << below)
        full = np.flatnonzero(edge[1:] > edge[:-1])
        blocks = [_pack(keys[edge[p] : edge[p + 1]] - (U(p) << below), counts[edge[p] : edge[p + 1]]) for p in full.tolist()]
        part = (table["part"][0].as_py() << fine_bits) + full
        return pa.table({"chunk": pa.array([table["group"][0].as_py()] * len(full), pa.int64()), "part": pa.array(part, pa.int64()), "block": pa.array(blocks, pa.binary())})

    return run


def _spread(table: pa.Table, answers: pa.Table) -> pa.Table:
    """The answers to a merged range of chunks, dealt to each chunk's own block again."""
    _, _, where, edge = _together(table["block"].to_pylist())
    totals = _counts_of(answers)
    found = [_answer(totals[where[a:b]]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return pa.table({"chunk": table["chunk"], "part": table["part"], "answer": pa.array(found, pa.binary())})


def _backoff(counts: list[np.ndarray], place: np.ndarray, all_words: np.ndarray, order: int, alpha: float, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """(log score, order used) of each word; counts has, by order, the count of the n-gram that ends at each word.

    A word that not even counts[0] holds scores as one among all words and itself, a step further back than a single word.
    """
    n_words = len(place)
    score, used = np.full(n_words, np.nan), np.zeros(n_words, np.int64)
    for n in range(order, 0, -1):
        own = counts[n - 1]
        context = all_words if n == 1 else np.concatenate([[1], counts[n - 2]])[:n_words]
        ok = np.isnan(score) & (place >= n - 1) & (own >= (1 if n == 1 else min_count))
        steps = np.minimum(place[ok], order - 1) - (n - 1)
        score[ok] = np.log(own[ok] / context[ok]) + steps * math.log(alpha)
        used[ok] = n
    rest = np.isnan(score)
    score[rest] = -np.log(all_words[rest] + 1) + (np.minimum(place[rest], order - 1) + 1) * math.log(alpha)
    return score, used


def _scored(order: int, alpha: float, min_count: int, n_words: int, id_type: pa.DataType):
    def run(packs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _unpacked(packs)
        texts = docs["text"].to_pylist()
        parsed, keys, all_keys = _chunk_keys(texts, order)
        every, where = np.unique(all_keys, return_inverse=True)
        totals = _counts_of(answers)[where] if len(where) else np.empty(0, np.int64)
        edge = np.cumsum([0] + [len(k) for k in keys])
        words, scores, hits, apart, elsewhere = [], [], [], [], []
        for b, (text, first, starts) in enumerate(parsed):
            total, other = [], []
            for n in range(order):
                at = slice(edge[b * order + n], edge[b * order + n] + len(starts[n]))
                _, same, times = np.unique(text[starts[n]] * len(every) + where[at], return_inverse=True, return_counts=True)
                for out, c in ((total, totals[at]), (other, totals[at] - times[same])):
                    full = np.zeros(len(text), np.int64)  # of the n-gram that ends at each word; 0 where there is none
                    full[starts[n] + n] = c
                    out.append(full)
            place, n_texts, own_words = np.arange(len(text)) - first[text], len(first) - 1, np.diff(first)
            score, used = _backoff(total, place, np.full(len(text), n_words), order, alpha, min_count)
            score_other, used_other = _backoff(other, place, n_words - own_words[text], order, alpha, min_count)
            words.append(own_words)
            scores.append(np.bincount(text, score, n_texts))
            hits.append(np.bincount(text, used == order, n_texts))
            apart.append(np.bincount(text, score_other, n_texts))
            elsewhere.append(np.bincount(text, used_other == order, n_texts))
        n, s, o = np.concatenate(words), np.concatenate(scores), np.concatenate(apart)
        whole = np.concatenate(elsewhere).astype(np.int64)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean, mean_other, share = np.round(s / n, 6), np.round(o / n, 6), np.floor(whole * 1_000_000 / (n - order + 1) + 0.5) / 1_000_000
        return pa.table(
            {
                "doc_id": docs["doc_id"].cast(id_type), "n_words": pa.array(n, pa.int64()), "log_score": pa.array(np.round(s, 4)),
                "mean_log_score": pa.array(mean, mask=n == 0), "n_full": pa.array(np.concatenate(hits).astype(np.int64)),
                "mean_log_score_elsewhere": pa.array(mean_other, mask=n == 0), "n_elsewhere": pa.array(whole), "share_elsewhere": pa.array(share, mask=n < order),
            }
        )

    return run


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score, n_full, mean_log_score_elsewhere, n_elsewhere, share_elsewhere), one row for each row of docs.

    Words are runs of non-blanks, A-Z lowered. With c the counts over all rows of docs, a word scores
    c(history, word) / c(history) for the longest history of up to order - 1 words of its text for which
    c(history, word) >= min_count (1 without a history), times alpha for every shortening; without a history,
    c(word) / all words. log_score is the sum of natural logarithms, mean_log_score that over n_words (null
    for a null, empty or blank text, whose log_score is 0), n_full the words scored with a full history.
    The columns with `elsewhere` are the same by the counts over all rows but the row itself: a word that no other row
    holds scores 1 / (all other words + 1), shortened once more; n_elsewhere are the words whose n-gram of full order stands in
    another row, share_elsewhere their share of those that have one (null with fewer than `order` words).
    min_count above 1 prunes n-grams of orders above 1, as tables of large models are. Repeated rows count and are
    scored each. An empty table gives an empty result; other columns are not read. Ids may have any type that a table can hold.
    """
    prepared(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    size = docs.select("text").mapInArrow(_sized, "n_bytes bigint, n_words bigint").agg(F.sum("n_bytes").alias("b"), F.sum("n_words").alias("w")).first()
    n_bytes, n_words = size["b"] or 0, size["w"] or 0
    n_chunks = max(1, -(-n_bytes // chunk_bytes))
    part_bits = max(0, (n_chunks - 1).bit_length())
    dealt = docs.mapInArrow(_packed(n_chunks), "chunk bigint, pack binary").repartition(n_chunks, "chunk")
    answered = "chunk bigint, part bigint, answer binary"
    block = "chunk bigint, part bigint, block binary"
    if part_bits <= FAN_BITS:
        answers = dealt.groupBy("chunk").applyInArrow(_blocks(order, part_bits), block).groupBy("part").applyInArrow(_answers, answered)
    else:
        fine = part_bits // 2
        coarse = part_bits - fine
        blocks = dealt.groupBy("chunk").applyInArrow(_blocks(order, coarse), block).withColumn("group", F.expr(f"shiftleft(part, 32) + shiftright(chunk, {coarse})"))
        merged = blocks.groupBy("group").applyInArrow(_merged(fine, BITS - coarse), block).groupBy("part").applyInArrow(_answers, answered)
        answers = blocks.groupBy("group").cogroup(merged.groupBy("chunk")).applyInArrow(_spread, answered)
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    return (
        dealt.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(_scored(order, alpha, min_count, n_words, id_type), f"doc_id {kind}, n_words bigint, log_score double, mean_log_score double, n_full bigint, mean_log_score_elsewhere double, n_elsewhere bigint, share_elsewhere double")
    )


#: The same rows in DuckDB by counting the n-grams themselves.
SCORE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS i, len(words) AS k FROM d),
g AS (SELECT doc_id, i, k, w, lag(w, 1) OVER o AS v, lag(w, 2) OVER o AS u FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w, count(*) AS n FROM g GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n FROM g WHERE i >= 1 GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS n FROM g WHERE i >= 2 GROUP BY u, v, w),
e1 AS (SELECT doc_id, w, count(*) AS n FROM g GROUP BY ALL),
e2 AS (SELECT doc_id, v, w, count(*) AS n FROM g WHERE i >= 1 GROUP BY ALL),
e3 AS (SELECT doc_id, u, v, w, count(*) AS n FROM g WHERE i >= 2 GROUP BY ALL),
a AS (
  SELECT g.doc_id, i, k, (SELECT count(*) FROM t) AS total, c1.n AS n1, c2.n AS n2, c3.n AS n3, x1.n AS h1, x2.n AS h2,
    c1.n - e1.n AS m1, c2.n - e2.n AS m2, c3.n - e3.n AS m3, x1.n - y1.n AS p1, x2.n - y2.n AS p2
  FROM g JOIN c1 ON c1.w = g.w JOIN e1 ON e1.doc_id = g.doc_id AND e1.w = g.w
  LEFT JOIN c2 ON c2.v = g.v AND c2.w = g.w LEFT JOIN e2 ON e2.doc_id = g.doc_id AND e2.v = g.v AND e2.w = g.w
  LEFT JOIN c3 ON c3.u = g.u AND c3.v = g.v AND c3.w = g.w LEFT JOIN e3 ON e3.doc_id = g.doc_id AND e3.u = g.u AND e3.v = g.v AND e3.w = g.w
  LEFT JOIN c1 x1 ON x1.w = g.v LEFT JOIN e1 y1 ON y1.doc_id = g.doc_id AND y1.w = g.v
  LEFT JOIN c2 x2 ON x2.v = g.u AND x2.w = g.v LEFT JOIN e2 y2 ON y2.doc_id = g.doc_id AND y2.v = g.u AND y2.w = g.v),
s AS (
  SELECT doc_id, CASE WHEN n3 IS NOT NULL THEN ln(n3 * 1.0::DOUBLE / h2) WHEN n2 IS NOT NULL THEN ln(n2 * 1.0::DOUBLE / h1) ELSE ln(n1 * 1.0::DOUBLE / total) END AS score, CAST(n3 IS NOT NULL AS INT) AS hit,
    CASE WHEN m3 >= 1 THEN ln(m3 * 1.0::DOUBLE / p2)
      WHEN m2 >= 1 THEN ln(m2 * 1.0::DOUBLE / p1) + CASE WHEN i >= 2 THEN ln(0.4::DOUBLE) ELSE 0 END
      WHEN m1 >= 1 THEN ln(m1 * 1.0::DOUBLE / (total - k)) + least(i, 2) * ln(0.4::DOUBLE)
      ELSE -ln(total - k + 1.0::DOUBLE) + (least(i, 2) + 1) * ln(0.4::DOUBLE) END AS other, CAST(coalesce(m3 >= 1, false) AS INT) AS elsewhere
  FROM a)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, round(coalesce(sum(score), 0), 4) AS log_score, round(sum(score) / len(words), 6) AS mean_log_score, CAST(coalesce(sum(hit), 0) AS BIGINT) AS n_full,
       round(sum(other) / len(words), 6) AS mean_log_score_elsewhere, CAST(coalesce(sum(elsewhere), 0) AS BIGINT) AS n_elsewhere, CASE WHEN len(words) >= 3 THEN round(sum(elsewhere) * 1.0::DOUBLE / (len(words) - 2), 6) END AS share_elsewhere
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, words
"""
