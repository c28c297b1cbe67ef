"""Conversation repair against a plain search for the least (cost, audit)."""

import hashlib
import random
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from lodestone.llm import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WS = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def search(rows):
    """rows: (initial, must go, truncated); the least (cost, audit) by trying everything, two insertions in a row at most."""

    @cache
    def best(i, done, inserted):
        """done: the last initial so far, '' at the start."""
        ways = []
        if i == len(rows) and done in ("", "a"):
            ways.append((0, ""))
        want = "a" if done == "u" else "u"
        if inserted < 2:
            ways.append(("I", 2, (i, want, inserted + 1)))
        if i < len(rows):
            initial, must, cut = rows[i]
            ways.append(("D", 3, (i + 1, done, 0)))
            if not must:
                if initial == want or (initial == "s" and done == ""):
                    ways.append(("K", cut, (i + 1, initial, 0)))
                ways.append(("R", 2 + cut, (i + 1, want, 0)))
        tried = []
        for w in ways:
            if len(w) == 2:
                tried.append(w)
            elif (rest := best(*w[2])) is not None:
                tried.append((w[1] + rest[0], w[0] + rest[1]))
        return min(tried, default=None)

    for i in range(len(rows), -1, -1):  # from behind, so that recursion stays shallow
        for inserted in (2, 1, 0):
            for done in ("", "s", "u", "a"):
                best(i, done, inserted)
    return best(0, "", 0)


def plain(original, rows):
    out = []
    for conv in {r[0] for r in original}:
        mine = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        turns = [r[1] for r in mine if r[1] is not None]
        seen, kinds, counts = set(), [], [0, 0, 0]
        for _, _, role, text in mine:
            content = text.strip(WS)
            faults = not content, (role, text) in seen, bool(content) and content[-1] not in ".!?"
            seen.add((role, text))
            if any(faults):
                counts[faults.index(True)] += 1
            kinds.append((role[:1], faults[0] or faults[1], faults[2]))
        cost, audit = search(tuple(kinds)) if mine else (0, "")
        fixed, i, last = [], 0, ""
        for a in audit:
            role = "assistant" if last == "u" else "user"
            if a == "I":
                fixed.append((role, ""))
            else:
                if a != "D":
                    fixed.append((mine[i][2] if a == "K" else role, mine[i][3]))
                i += 1
            last = fixed[-1][0][:1] if fixed else ""
        illegal = sum(x[0] + y[0] not in ("su", "ua", "au") for x, y in zip(kinds, kinds[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()))
    return sorted(out, key=repr)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _talk(seed, conversations, turns):
    draw = random.Random(seed)
    out = []
    for c in range(conversations):
        for t in range(draw.randint(1, turns)):
            if draw.random() < 0.9:
                role = draw.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
                text = draw.choice(["", " \n", "cut off", None]) if draw.random() < 0.3 else f"{draw.randint(0, 6)} words." + draw.choice(["", "\n", "é?"])
                out.append((c if c else None, draw.choice([t, t, t, None]), role, text))
    return out


@pytest.mark.parametrize("bits, seed", [(9, 1), (1, 2), (2, 3)])
def test_plain_search(spark, monkeypatch, bits, seed):
    monkeypatch.setattr(C, "BLOCK_BITS", bits)  # small blocks cut every conversation
    talk = _talk(seed, 150, 14)
    df = spark.createDataFrame(talk, SCHEMA).repartition(6)
    assert _rows(C.report(C.damaged(df), df)) == plain(talk, damage(talk))


def test_a_conversation_that_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_BITS", 5)
    talk = [(7, t, r, f"{t} says." if t % 13 else "same") for t in range(1500) for r in [("user", "assistant", "user", "tool")[(t * t) % 4]]] + _talk(4, 30, 6)
    df = spark.createDataFrame(talk, SCHEMA)
    assert _rows(C.report(C.damaged(df), df)) == plain(talk, damage(talk))


def test_awkward_rows(spark):
    talk = [(1, None, None, None), (1, None, None, None), (2, 5, "user", ""), (3, 0, "user", "Hi."), (3, 9, "assistant", "x" * 100000 + "."), (None, 1, "assistant", "Yes."), (4, 1, "system", "Be kind."), (4, 1, "system", "Be kind.")]
    df = spark.createDataFrame(talk, SCHEMA)
    clash = df.select("*", *[F.lit(1).alias(c) for c in ("key", "pos", "block", "h", "code", "copy", "blank", "cost", "initial")])
    assert _rows(C.report(clash)) == plain(talk, [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in talk])
    assert C.report(df.limit(0)).collect() == []
    assert _rows(C.report(df.limit(0), df.where("conv_id = 2"))) == [(2, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    turns = sorted((r.conv_id, r.place, r.role, r.text) for r in C.repaired(df.where("conv_id = 4")).collect())
    assert [t[2:] for t in turns] == []  # a system turn alone is cheaper to delete than to answer
    assert [r[2:] for r in sorted((r.conv_id, r.place, r.role, r.text) for r in C.repaired(df.where("conv_id IS NULL")).collect())] == [("user", ""), ("assistant", "Yes.")]


def test_ties_are_least_in_ascii():
    # a lone truncated assistant row: insert and keep costs 3, delete costs 3, and D is least
    kinds = [("a", False, True)]
    costs = C.costs_to_go(kinds, C.END)
    assert costs[0][C.START] == 3 and C.walk(kinds, costs, C.START, True)[0] == "D"
