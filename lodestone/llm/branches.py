"""Three-way merge of document branches as a fold of unit states in a semilattice.

A document is cut into units that merge by themselves: the row, each column, each line of the text and the gap
behind each line. What the base and the two branches say about a unit are states (branch, value), a null value for
a unit that is removed; a branch that says nothing keeps what the base has. The states of one branch are joined in
the flat lattice nothing < one value < contradiction, kept as the least and the greatest value, so the join is
associative, commutative and idempotent: it runs on the map side first, in any order, and a state that is told
twice counts once. The fold of a unit is its version triple (base, left, right); a column expression then
decides what is left of it and counts a clean change or a conflict.

Documents are put together again as a tree of ordered fragments: the lines of a block of BLOCK lines, then FAN blocks,
then the whole text. Units are dealt by document and block, so a block is folded and joined in one shuffle; its text
travels once more, to its document. Nothing goes through one task, to the driver or into a broadcast
but, of ids that are repeated, those which hold more than one row in 10,000 (hot_join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join

#: Lines of a block, and blocks of a fragment of the next level.
BLOCK, FAN = 256, 64
#: Kinds of units. A gap is at the number of the line before it.
ROW, COLUMN, LINE, GAP = 0, 1, 2, 3
BASE, LEFT, RIGHT = 0, 1, 2
COUNTS = ("n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")


def fold(states: DataFrame, *keys: str, **more: Column) -> DataFrame:
    """The version triple of each unit: (keys, base, left, right) of structs (value, ..), null for a branch that says nothing.

    states: (keys, branch, value). left_2 and right_2 are another value that the branch gives, equal to the first if it
    gives only one. more: further aggregates.
    """
    said = {b: F.when(F.col("branch") == b, F.struct("value")) for b in (BASE, LEFT, RIGHT)}
    return states.groupBy(*keys).agg(
        F.max(said[BASE]).alias("base"),
        *[f(said[b]).alias(name) for b, side in ((LEFT, "left"), (RIGHT, "right")) for f, name in ((F.min, side), (F.max, f"{side}_2"))],
        *[c.alias(name) for name, c in more.items()],
    )


def resolved(folded: DataFrame) -> DataFrame:
    """Of version triples: base and merged values (null: not there), whether either side changes it, and what it counts as."""
    base = F.col("base.value")
    out = folded.withColumn("base_value", base)
    for side in ("left", "right"):
        value = F.when(F.col(side).isNull(), base).otherwise(F.col(f"{side}.value"))
        out = out.withColumn(f"{side}_value", value).withColumn(f"{side}_changes", ~value.eqNullSafe(base) | ~F.col(f"{side}_2").eqNullSafe(F.col(side)))
    torn = [~F.col(f"{side}_2").eqNullSafe(F.col(side)) for side in ("left", "right")]
    left, right = F.col("left_changes"), F.col("right_changes")
    conflict = torn[0] | torn[1] | (left & right & ~F.col("left_value").eqNullSafe(F.col("right_value")))
    gone = F.col("left_value").isNull() | F.col("right_value").isNull()
    out = out.withColumn("conflict", conflict).withColumn("merged", F.when(F.col("conflict"), F.col("base_value")).when(left, F.col("left_value")).otherwise(F.col("right_value")))
    kinds = {
        "n_clean": (left | right) & ~F.col("conflict"),
        "n_edit_edit": F.col("conflict") & F.col("base_value").isNotNull() & ~gone,
        "n_edit_delete": F.col("conflict") & F.col("base_value").isNotNull() & gone,
        "n_insert_insert": F.col("conflict") & F.col("base_value").isNull(),
    }
    return out.withColumns({name: c.cast("bigint") for name, c in kinds.items()})


def _joined(pieces: str, what: str) -> Column:
    """The pieces in order, with line feeds between them; null without any."""
    texts = f"transform(array_sort({pieces}), x -> x.{what})"
    return F.expr(f"CASE WHEN exists({pieces}, x -> x.{what} IS NOT NULL) THEN array_join({texts}, '\\n') END")


def _sums() -> list[Column]:
    flags = [F.max(c).alias(c) for c in ("left_drops", "right_drops")]
    return flags + [F.sum(c).alias(c) for c in ("left_edits", "right_edits", *COUNTS)]


def merge(states: DataFrame, columns: list[str]) -> DataFrame:
    """(doc_id, twin, columns, text, n_clean, n_edit_edit, n_edit_delete, n_insert_insert), a row for each document of the base.

    states: (doc_id, twin, unit, pos, branch, value, lines). A document of the base says BASE for its row (value '', and
    `lines`, the number of its lines), for its columns (pos: the column's place in `columns`) and its lines; branches say
    what they change. A branch removes a row or a line by a null value, and inserts lines by the value of a gap.
    Units that one side changes, or both alike, count as clean; others as conflicts, in which the base's value stays. A branch
    that removes the row overrules nothing that the other changes: then the whole base row stays, as one edit-delete
    conflict; else the row goes as one clean change, and columns and text are null. A text of no lines is empty.
    (doc_id, twin) is the document's key; both may be null. Documents that only branches speak of are left out.
    """
    keys = ["doc_id", "twin", "block"]
    dealt = states.withColumn("block", F.floor(F.col("pos") / BLOCK)).repartition(*keys)
    units = resolved(fold(dealt, *keys, "pos", "unit", lines=F.max("lines")))
    row, column, text = F.col("unit") == ROW, F.col("unit") == COLUMN, F.col("unit") >= LINE
    own = {"left_drops": row & F.col("left_changes"), "right_drops": row & F.col("right_changes"), "left_edits": ~row & F.col("left_changes"), "right_edits": ~row & F.col("right_changes")}
    units = units.withColumns({k: v.cast("bigint") for k, v in own.items()}).withColumns({k: F.when(~row, F.col(k)).otherwise(0) for k in COUNTS})
    at = [F.max(F.when(column & (F.col("pos") == i), F.struct(F.col("merged"), F.col("base_value").alias("base")))).alias(f"column_{i}") for i in range(len(columns))]
    piece = F.when(text, F.struct("pos", "unit", "merged", F.col("base_value").alias("base")))
    blocks = units.groupBy(*keys).agg(F.max("lines").alias("lines"), *at, *_sums(), F.collect_list(piece).alias("pieces"))
    blocks = blocks.withColumns({"merged": _joined("pieces", "merged"), "base": _joined("pieces", "base")}).drop("pieces")

    # The base's text is asked for only where a branch drops the row, which the first block knows.
    kept = (F.col("block") > 0) | (F.col("left_drops") == 1) | (F.col("right_drops") == 1)
    whole = blocks.withColumn("base", F.when(kept, F.col("base"))).withColumn("part", F.floor(F.col("block") / FAN)).repartition("doc_id", "twin")
    for level, place in ((["doc_id", "twin", "part"], "block"), (["doc_id", "twin"], "part")):
        piece = F.struct(place, "merged", "base")
        whole = whole.groupBy(*level).agg(F.max("lines").alias("lines"), *[F.max(f"column_{i}").alias(f"column_{i}") for i in range(len(columns))], *_sums(), F.collect_list(piece).alias("pieces"))
        whole = whole.withColumns({"merged": _joined("pieces", "merged"), "base": _joined("pieces", "base")}).drop("pieces")
    whole = whole.where("lines IS NOT NULL")

    left, right = F.col("left_drops") == 1, F.col("right_drops") == 1
    clash = (left & ~right & (F.col("right_edits") > 0)) | (right & ~left & (F.col("left_edits") > 0))
    whole = whole.withColumn("dropped", left | right).withColumn("clash", clash)
    gone = F.col("dropped") & ~F.col("clash")
    state = lambda name: F.when(~gone, F.when(F.col("clash"), F.col(f"{name}base")).otherwise(F.col(f"{name}merged")))
    alone = {"n_clean": gone, "n_edit_edit": F.lit(False), "n_edit_delete": F.col("clash"), "n_insert_insert": F.lit(False)}
    return whole.select(
        "doc_id",
        "twin",
        *[state(f"column_{i}.").alias(c) for i, c in enumerate(columns)],
        F.when(~gone, F.coalesce(state(""), F.lit(""))).alias("text"),
        *[F.when(F.col("dropped"), c.cast("bigint")).otherwise(F.col(name)).alias(name) for name, c in alone.items()],
    )


def merge_added(states: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that branches add: states (doc_id, branch, value), the value a struct of the columns; gives (doc_id, columns, counts).

    A row that one branch adds, or both alike, is there and counts as clean; of others nothing stays, as one insert-insert conflict.
    """
    found = resolved(fold(states, "doc_id"))
    return found.select("doc_id", *[F.col(f"merged.{c}").alias(c) for c in columns], *COUNTS)


def code(branch: str, doc_id: Column, name: Column) -> Column:
    """The number from 0 to 10 by which a branch decides what it does with what is so named."""
    text = F.concat(F.lit(f"{branch}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), name)
    return F.crc32(text) % 11


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a column twin: 1 for a null id and else 0, or for ids that several rows have a hash of the row; rows that are equal become one.

    twin is no constant, which Spark would take out of the grouping but not of the partitioning, and shuffle again.
    """
    plain = F.col("doc_id").isNull().cast("bigint").alias("twin")
    again = docs.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("again"))
    if again.isEmpty():
        return docs.select("*", plain)
    id_ = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))  # a struct is never null, so null ids meet
    marked = hot_join(docs.withColumn("id", id_), again.select(id_.alias("id"), "again"), ["id"], "left").drop("id")
    once = marked.where("again IS NULL").select(*docs.columns, plain)
    twins = marked.where("again").select(*docs.columns).distinct().withColumn("twin", F.xxhash64(*[c for c in docs.columns if c != "doc_id"]))
    return once.unionByName(twins)


def branch_states(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The states of two branches that change docs (doc_id, twin, columns, text) by the codes of what they find, and of the rows that they add."""
    names = F.array(*map(F.lit, columns))
    line = lambda x, i: F.struct(F.lit(LINE).alias("unit"), i.cast("bigint").alias("pos"), x.alias("value"))
    unit = lambda kind, pos, value: F.struct(F.lit(kind).alias("unit"), F.lit(pos).cast("bigint").alias("pos"), value.alias("value"))
    cut = docs.select("doc_id", "twin", *columns, F.split("text", "\n", -1).alias("found"))
    units = F.concat(F.array(unit(ROW, 0, F.lit("")), *[unit(COLUMN, i, F.col(c)) for i, c in enumerate(columns)]), F.transform("found", line))
    each = cut.select("doc_id", "twin", F.size("found").cast("bigint").alias("lines"), F.explode(units).alias("u")).select("doc_id", "twin", "lines", "u.*")
    name = F.when(F.col("unit") == ROW, "row").when(F.col("unit") == COLUMN, F.element_at(names, F.col("pos").cast("int") + 1)).otherwise(F.col("pos").cast("string"))
    each = each.withColumn("name", name).withColumns({b: code(b, F.col("doc_id"), F.col("name")) for b in "LR"})

    def state(branch: int, changes: Column, gap: Column, value: Column) -> Column:
        kind = F.when(gap, GAP).otherwise(F.col("unit"))
        return F.when(changes, F.struct(kind.alias("unit"), F.col("pos"), F.lit(branch).alias("branch"), value.alias("value"), F.when((F.col("unit") == ROW) & F.lit(branch == BASE), F.col("lines")).alias("lines")))

    said = [state(BASE, F.lit(True), F.lit(False), F.col("value"))]
    for branch, b in ((LEFT, "L"), (RIGHT, "R")):
        got, row, line_ = F.col(b), F.col("unit") == ROW, F.col("unit") == LINE
        mark = F.when(got % 2 == 1, "!").otherwise("?")
        changes = (got == 0) | (got.isin(1, 2) & ~row) | (got.isin(3, 4) & line_)
        value = F.when(got == 0, F.when(F.col("unit") == COLUMN, "")).when(got.isin(1, 2), F.concat("value", mark)).otherwise(mark)
        said.append(state(branch, changes, got >= 3, value))
    states = each.select("doc_id", "twin", F.explode(F.array_compact(F.array(*said))).alias("s")).select("doc_id", "twin", "s.*")

    added = []
    for branch, b in ((LEFT, "L"), (RIGHT, "R")):
        got = code(b, F.col("doc_id"), F.lit("row"))
        row = F.struct(*columns, F.when(F.col("got") == 3, "!").otherwise("?").alias("text"))
        rows = docs.where("doc_id IS NOT NULL").withColumn("got", got).where("got IN (3, 4)")
        added.append(rows.select((F.lit(-branch) - F.col("doc_id")).alias("doc_id"), F.lit(branch).alias("branch"), row.alias("value")))
    return states, added[0].unionByName(added[1])


def merge_branches(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, text, counts): docs merged from two branches that the codes of their parts make.

    Null texts and columns count as empty, a null id as empty in codes. A row for every id ever there, lang, source and
    text null where the merge leaves no row. Rows that repeat an id are documents of their own, equal ones one; a
    document with a null id adds no rows, and rows that branches add under an id of the base are rows of their own. Ids must be whole numbers, as added rows take
    theirs from them; merge() itself takes any. An empty table gives an empty result; other columns are not read.
    """
    columns = ["lang", "source"]
    docs = docs.select("doc_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*columns, "text")])
    states, added = branch_states(keyed(docs), columns)
    return merge(states, columns).drop("twin").unionByName(merge_added(added, [*columns, "text"]))


def digest(merged: DataFrame) -> DataFrame:
    """The merged documents with the SHA-256 of their texts in place of these."""
    return merged.select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"), *COUNTS)


_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ord(x)::BIGINT)),
  lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1]))"""


def _code_sql(branch: str) -> str:
    return f"xor({_CRC.format(f'''('{branch}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || name)''')}, 4294967295) % 11"


#: The same rows in DuckDB, units joined by name; the table of the checksum follows from its polynomial.
MERGE_SQL = f"""
WITH crc AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
u AS (
  SELECT doc_id, 'row' AS name, 0 AS kind, 0 AS pos, '' AS v FROM d UNION ALL SELECT doc_id, 'lang', 1, 0, lang FROM d UNION ALL SELECT doc_id, 'source', 1, 1, source FROM d
  UNION ALL SELECT doc_id, CAST(unnest(range(len(lines))) AS VARCHAR), 2, unnest(range(len(lines))), unnest(lines) FROM d),
c AS MATERIALIZED (SELECT *, {_code_sql("L")} AS l, {_code_sql("R")} AS r FROM u CROSS JOIN crc),
e AS (
  SELECT doc_id, kind, pos, v, CASE WHEN l = 0 AND kind = 1 THEN '' WHEN l = 0 THEN NULL WHEN kind > 0 AND l = 1 THEN v || '!' WHEN kind > 0 AND l = 2 THEN v || '?' ELSE v END AS a,
    CASE WHEN r = 0 AND kind = 1 THEN '' WHEN r = 0 THEN NULL WHEN kind > 0 AND r = 1 THEN v || '!' WHEN kind > 0 AND r = 2 THEN v || '?' ELSE v END AS b FROM c
  UNION ALL SELECT doc_id, 3, pos, NULL, CASE l WHEN 3 THEN '!' WHEN 4 THEN '?' END, CASE r WHEN 3 THEN '!' WHEN 4 THEN '?' END FROM c WHERE kind = 2),
f AS (SELECT *, a IS DISTINCT FROM v AS ca, b IS DISTINCT FROM v AS cb, ca AND cb AND a IS DISTINCT FROM b AS x, CASE WHEN x THEN v WHEN ca THEN a ELSE b END AS m FROM e),
g AS (
  SELECT doc_id, bool_or(kind = 0 AND ca) AS da, bool_or(kind = 0 AND cb) AS db, bool_or(kind > 0 AND ca) AS ea, bool_or(kind > 0 AND cb) AS eb,
    count(*) FILTER (kind > 0 AND (ca OR cb) AND NOT x) AS n_clean, count(*) FILTER (kind > 0 AND x AND v IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL) AS ee,
    count(*) FILTER (kind > 0 AND x AND v IS NOT NULL AND (a IS NULL OR b IS NULL)) AS ed, count(*) FILTER (kind > 0 AND x AND v IS NULL) AS ii,
    max(m) FILTER (kind = 1 AND pos = 0) AS lang, max(v) FILTER (kind = 1 AND pos = 0) AS lang_0, max(m) FILTER (kind = 1 AND pos = 1) AS source, max(v) FILTER (kind = 1 AND pos = 1) AS source_0,
    coalesce(string_agg(m, chr(10) ORDER BY pos, kind) FILTER (kind >= 2 AND m IS NOT NULL), '') AS text, coalesce(string_agg(v, chr(10) ORDER BY pos, kind) FILTER (kind = 2), '') AS text_0
  FROM f GROUP BY doc_id),
h AS (SELECT *, da OR db AS dropped, (da AND NOT db AND eb) OR (db AND NOT da AND ea) AS clash FROM g),
n AS (
  SELECT -1 - doc_id AS doc_id, 1 AS side, struct_pack(lang := lang, source := source, text := CASE l WHEN 3 THEN '!' ELSE '?' END) AS s FROM c JOIN d USING (doc_id) WHERE kind = 0 AND l IN (3, 4)
  UNION ALL SELECT -2 - doc_id, 2, struct_pack(lang := lang, source := source, text := CASE r WHEN 3 THEN '!' ELSE '?' END) FROM c JOIN d USING (doc_id) WHERE kind = 0 AND r IN (3, 4)),
o AS (SELECT doc_id, count(DISTINCT s) AS k, min(s) AS s FROM n GROUP BY doc_id)
SELECT doc_id, CASE WHEN NOT dropped THEN lang WHEN clash THEN lang_0 END AS lang, CASE WHEN NOT dropped THEN source WHEN clash THEN source_0 END AS source,
  CASE WHEN NOT dropped THEN sha256(text) WHEN clash THEN sha256(text_0) END AS text_sha256, CAST(CASE WHEN dropped THEN CASE WHEN clash THEN 0 ELSE 1 END ELSE n_clean END AS BIGINT) AS n_clean,
  CAST(CASE WHEN dropped THEN 0 ELSE ee END AS BIGINT) AS n_edit_edit, CAST(CASE WHEN dropped THEN CASE WHEN clash THEN 1 ELSE 0 END ELSE ed END AS BIGINT) AS n_edit_delete, CAST(CASE WHEN dropped THEN 0 ELSE ii END AS BIGINT) AS n_insert_insert FROM h
UNION ALL SELECT doc_id, CASE k WHEN 1 THEN s.lang END, CASE k WHEN 1 THEN s.source END, CASE k WHEN 1 THEN sha256(s.text) END, CAST(k = 1 AS BIGINT), 0, 0, CAST(k > 1 AS BIGINT) FROM o
"""
