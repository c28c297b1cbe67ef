"""Repair of conversation structure by the cheapest edits, over conversations of any length.

Roles must read (s?(ua)+)?: a system turn or none, then user and assistant in turn. A row is kept (0), given the role that
the grammar wants (2), or deleted (3); an empty turn of that role may be inserted anywhere (2); a truncated row that stays
costs 1 more, and blank or repeated rows must go. What each edit does follows from the grammar's state, so the edits'
initials alone tell a repair. A backward pass gives the cost to go from every row and state; a forward walk
then takes, of the edits on a cheapest way, the one whose initial is least, which makes the least audit of all.

Rows are sorted by range over the whole table (conversation, turn, role, text's hash), so a conversation is
a run of rows that may lie in many partitions, and a block is BLOCK rows of the order, whatever they belong to.
A conversation inside one block is repaired at once. One that blocks cut, however long it is, takes three steps more, without its texts: each
block's least costs from state to state are a matrix, the products of these from behind give the costs to go at every cut;
with them a block maps the state before it to the one behind it, and these maps, applied from the front, give the state at every cut.
So no task holds more rows than a block's, or one row for each block of a conversation; only SHA-256, which
goes through the text in order by its nature, has one task pass a conversation's blocks one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, prepared, staged

#: Rows of a block, as a power of two.
BLOCK_BITS = 9
BLANKS = " \t\n\x0b\x0c\r"
#: States of the grammar: the start, after a system, a user and an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The state behind a turn of the role that is wanted, and that role.
WANTS = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
REROLE = INSERT = 2
DELETE, CUT_OFF = 3, 1
NEVER = 1 << 40
#: The costs to go behind the last row: to turns that end with an assistant, or to none.
END = (0, 2 * INSERT, INSERT, 0)
LEGAL = {"su", "ua", "au"}

Costs = tuple[int, ...]
#: What the edits of a row depend on: its role's initial, whether it must go, and whether it is cut off.
Kind = tuple[str, bool, bool]


def _edits(kind: Kind, state: int) -> list[tuple[str, int, int]]:
    """The edits that use the row up, by initial: (initial, cost, state behind)."""
    initial, must_go, cut_off = kind
    out = [("D", DELETE, state)]
    if not must_go:
        if (state, initial) in KEEPS:
            out.append(("K", CUT_OFF * cut_off, KEEPS[state, initial]))
        out.append(("R", REROLE + CUT_OFF * cut_off, WANTS[state]))
    return out


@lru_cache(maxsize=1 << 14)
def _step(kind: Kind, behind: Costs) -> Costs:
    used = [min(c + behind[q] for _, c, q in _edits(kind, s)) for s in STATES]
    # two insertions lead to every state that any number does
    return tuple(min(used[s], INSERT + used[WANTS[s]], 2 * INSERT + used[WANTS[WANTS[s]]]) for s in STATES)


def costs_to_go(kinds: list[Kind], end: Costs) -> list[Costs]:
    """The least cost from each row and state on, insertions before the row included; the last are `end`."""
    out = [end]
    for kind in reversed(kinds):
        least = min(out[-1])
        out.append(tuple(x + least for x in _step(kind, tuple(x - least for x in out[-1]))))
    return out[::-1]


def walk(kinds: list[Kind], costs: list[Costs], state: int, last: bool) -> tuple[str, int]:
    """The least edits on a cheapest way from the first row and `state`, and the state behind; insertions behind the rows if they are the last."""
    audit = []
    for i, kind in enumerate(kinds):
        while True:
            left = costs[i][state]
            ways = [(a, q, c + costs[i + 1][q]) for a, c, q in _edits(kind, state)] + [("I", WANTS[state], INSERT + costs[i][WANTS[state]])]
            edit, state, _ = min(w for w in ways if w[2] == left)
            audit.append(edit)
            if edit != "I":
                break
    while last and costs[-1][state]:
        audit.append("I")
        state = WANTS[state]
    return "".join(audit), state


def _runs(keys: list[str]) -> Iterator[tuple[int, int]]:
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start]:
            yield start, i
            start = i


def _kinds(rows: pa.Table) -> list[Kind]:
    return list(zip(*(rows[c].to_pylist() for c in ("initial", "must_go", "cut_off"))))


def _crossed(rows: pa.Table) -> pa.Table:
    """Of each conversation's rows in the block, the least cost from each state to each, as 16 numbers."""
    rows = rows.sort_by("pos")
    keys, kinds, out = rows["key"].to_pylist(), _kinds(rows), []
    for a, b in _runs(keys):
        ways = [costs_to_go(kinds[a:b], tuple(0 if q == t else NEVER for q in STATES))[0] for t in STATES]
        out.append((keys[a], rows["block"][a].as_py(), [ways[t][s] for s in STATES for t in STATES]))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.list_(pa.int64())))], names=["key", "block", "numbers"])


def _passed(rows: pa.Table) -> pa.Table:
    """As _crossed(), but of each state the one behind the rows, for the costs to go that are given."""
    rows = rows.sort_by("pos")
    keys, kinds, out = rows["key"].to_pylist(), _kinds(rows), []
    for a, b in _runs(keys):
        costs = costs_to_go(kinds[a:b], tuple(rows["end"][a].as_py()))
        out.append((keys[a], rows["block"][a].as_py(), [walk(kinds[a:b], costs, s, False)[1] for s in STATES]))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.list_(pa.int64())))], names=["key", "block", "numbers"])


def _ends(blocks: pa.Table) -> pa.Table:
    """Of one conversation's blocks, the costs to go behind each."""
    blocks, now, out = blocks.sort_by("block"), END, []
    for m in reversed(blocks["numbers"].to_pylist()):
        out.append(list(now))
        now = tuple(min(m[4 * s + t] + now[t] for t in STATES) for s in STATES)
    return pa.table([blocks["key"], blocks["block"], pa.array(out[::-1], pa.list_(pa.int64()))], names=["key", "block", "end"])


def _starts(blocks: pa.Table) -> pa.Table:
    """Of one conversation's blocks, the state before each."""
    blocks, state, out = blocks.sort_by("block"), START, []
    for behind in blocks["numbers"].to_pylist():
        out.append(state)
        state = behind[state]
    last = [False] * (len(out) - 1) + [True]
    return pa.table([blocks["key"], blocks["block"], pa.array(out, pa.int32()), pa.array(last)], names=["key", "block", "state", "last"])


_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_PARTS = "key string, block bigint, initials array<string>, illegal bigint, cost bigint, audit string, turns array<struct<role string, text string>>"


def _mended(rows: pa.Table, cuts: pa.Table) -> pa.Table:
    """The block's part of each conversation: its first and last initial, illegal neighbours, cost, edits and repaired turns."""
    rows = rows.sort_by("pos")
    cut = {k: (tuple(end), state, last) for k, end, state, last in zip(*(cuts[c].to_pylist() for c in ("key", "end", "state", "last")))}
    keys, kinds, roles, texts = rows["key"].to_pylist(), _kinds(rows), rows["role"].to_pylist(), rows["text"].to_pylist()
    out = []
    for a, b in _runs(keys):
        end, state, last = cut.get(keys[a], (END, START, True))
        costs = costs_to_go(kinds[a:b], end)
        audit, _ = walk(kinds[a:b], costs, state, last)
        spent, at, turns = 0, a, []
        for edit in audit:
            if edit == "I":
                turns.append({"role": ROLES[WANTS[state]], "text": ""})
                spent, state = spent + INSERT, WANTS[state]
                continue
            _, price, behind = next(e for e in _edits(kinds[at], state) if e[0] == edit)
            if edit != "D":
                turns.append({"role": roles[at] if edit == "K" else ROLES[behind], "text": texts[at]})
            spent, state, at = spent + price, behind, at + 1
        initials = [k[0] for k in kinds[a:b]]
        illegal = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:]))
        out.append((keys[a], rows["block"][a].as_py(), [initials[0], initials[-1]], illegal, spent, audit, turns))
    types = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string(), pa.list_(_TURN))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], names=["key", "block", "initials", "illegal", "cost", "audit", "turns"])


def _summed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the parts of conversations, in order: a row each, the texts hashed as they go by."""
    names = ["key", "illegal", "cost", "audit", "repaired_sha256"]
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    key, done = None, []

    def close() -> None:
        if key is not None:
            done.append((key, illegal, cost, "".join(audit), digest.hexdigest()))

    for batch in it:
        for part in batch.to_pylist():
            if part["key"] != key:
                close()
                key, illegal, cost, audit, digest, last, begun = part["key"], 0, 0, [], hashlib.sha256(), None, False
            first, behind = part["initials"]
            illegal += part["illegal"] + (last is not None and last + first not in LEGAL)
            cost, last = cost + part["cost"], behind
            audit.append(part["audit"])
            for turn in part["turns"]:
                digest.update(f"{chr(10) * begun}{turn['role']}:{turn['text']}".encode())
                begun = True
        if done:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
            done = []
    close()
    if done:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)


def _key() -> Column:
    """A conversation's id as a text; a null id is one of its own."""
    return F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string"))).alias("key")


def _in_order(rows: DataFrame) -> DataFrame:
    """The rows with their key, place in the order of all, block, and what their edits depend on but for repetition."""
    rows = rows.select(_key(), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.withColumns({"h": F.md5("text"), "salt": F.monotonically_increasing_id()})  # the salt parts equal rows only
    order = ["key", F.col("turn").asc_nulls_first(), "role", "h", "salt"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt").withColumn("pos", F.monotonically_increasing_id())
    content = F.rtrim("text", F.lit(BLANKS))
    kinds = {"block": F.shiftright("pos", BLOCK_BITS), "initial": F.substring("role", 1, 1), "blank": content == "", "cut_off": (content != "") & ~F.right(content, F.lit(1)).isin(".", "!", "?")}
    return staged(rows.withColumns(kinds), "turns")


def _parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The parts of the repaired conversations, and the rows without their texts."""
    prepared(rows.sparkSession)
    rows = _in_order(rows)
    light = rows.drop("text")
    same = ["key", "role", "h"]
    first = light.groupBy(same).agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = hot_join(light, first, same).where("pos <> first").select("pos", F.lit(True).alias("duplicate"))
    light = light.drop("role", "h").join(again, "pos", "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))
    light = staged(light.withColumn("must_go", F.col("blank") | F.col("duplicate")), "kinds")

    pieces = light.groupBy("key", "block").count().select("key", "block")
    long = pieces.groupBy("key").count().where("count > 1").select("key")
    pieces = staged(pieces.join(long, "key", "left_semi"), "cuts")
    cut = staged(light.join(pieces, ["key", "block"], "left_semi").select("key", "block", "pos", "initial", "must_go", "cut_off"), "cut")
    crossed = cut.groupBy("block").applyInArrow(_crossed, "key string, block bigint, numbers array<bigint>")
    ends = staged(crossed.groupBy("key").applyInArrow(_ends, "key string, block bigint, end array<bigint>"), "ends")
    passed = cut.join(ends, ["key", "block"]).groupBy("block").applyInArrow(_passed, "key string, block bigint, numbers array<bigint>")
    starts = passed.groupBy("key").applyInArrow(_starts, "key string, block bigint, state int, last boolean")
    cuts = ends.join(starts, ["key", "block"])

    whole = rows.select("pos", "key", "block", "role", "text", "initial").join(light.select("pos", "must_go", "cut_off"), "pos")
    parts = whole.groupBy("block").cogroup(cuts.groupBy("block")).applyInArrow(_mended, _PARTS)
    return staged(parts, "parts"), light


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id as text, place, role, text): the turns of the repaired conversations, place in their order (ascending, with gaps)."""
    parts, _ = _parts(rows)
    turns = parts.select("key", "block", F.posexplode("turns").alias("n", "turn"))
    return turns.select(F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).alias("conv_id"), F.struct("block", "n").alias("place"), "turn.role", "turn.text")


def report(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each id of `every`, or of rows.

    rows: (conv_id, turn, role, text). A conversation's rows go by turn, nulls first, then by role and the MD5 of the text; a null
    role or text counts as one blank, null ids as one conversation. Of each row the first of its faults counts: blank (nothing but ASCII blanks), duplicate
    (role and text stood before in the conversation), truncated (the last other character is no . ! or ?). gaps are turns
    missing between the least and the greatest, illegal neighbouring roles that the grammar does not allow. audit has the initials of the edits (Keep,
    Rerole, Delete, Insert), the least in ASCII of the cheapest; repaired_sha256 is of the repaired turns as role:text, joined by line feeds.
    Ids of `every` without rows have zeros, an empty audit and the hash of nothing. Empty tables give empty results; other columns are not read.
    """
    every = (rows if every is None else every).select("conv_id", _key()).distinct()
    parts, light = _parts(rows)
    span = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    counts = {"blank": F.col("blank"), "duplicate": ~F.col("blank") & F.col("duplicate"), "truncated": F.col("cut_off") & ~F.col("duplicate")}
    facts = light.groupBy("key").agg(F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps"), *[F.sum(c.cast("bigint")).alias(k) for k, c in counts.items()])
    sums = parts.repartition("key").sortWithinPartitions("key", "block").mapInArrow(_summed, "key string, illegal bigint, cost bigint, audit string, repaired_sha256 string")
    found = every.join(facts, "key", "left").join(sums, "key", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties its text, 2 takes its . ! and ? away, 3 repeats it, 4 makes it a user's.

    Nulls count as one blank, in the checksum too; a null id or turn stays null.
    """
    names = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    code = F.crc32(F.concat(names[0], F.lit(":"), names[1])) % 20
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", names[2].alias("role"), names[3].alias("text"), code.alias("code")).where("code <> 0")
    rows = rows.withColumn("role", F.when(F.col("code") == 4, "user").otherwise(F.col("role"))).withColumn("text", text)
    times = F.array_repeat(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1))
    return rows.withColumn("copy", F.explode(times)).drop("code", "copy")
