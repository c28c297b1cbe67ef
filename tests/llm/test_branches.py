"""The merge of branches against plain Python, fold by fold."""

import hashlib
import random
import zlib

from lodestone.llm import branches as B
from tests.llm.conftest import AWKWARD


def _code(branch, doc_id, name):
    return zlib.crc32(f"{branch}:{'' if doc_id is None else doc_id}:{name}".encode()) % 11


def plain(docs):
    """The rows of the contract, for distinct rows (doc_id, text, lang, source)."""
    out, added = [], {}
    for doc_id, text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        lines, counts, left = text.split("\n"), dict.fromkeys(B.COUNTS, 0), {}
        gone = {b: _code(b, doc_id, "row") == 0 for b in "LR"}
        for k, b in ((1, "L"), (2, "R")):
            if doc_id is not None and (c := _code(b, doc_id, "row")) in (3, 4):
                added.setdefault(-k - doc_id, []).append((lang, source, "!" if c == 3 else "?"))

        def decide(base, l, r):
            if l == base and r == base:
                return base
            left["L"], left["R"] = left.get("L") or l != base, left.get("R") or r != base
            if l == base or r == base or l == r:
                counts["n_clean"] += 1
                return r if l == base else l
            counts["n_insert_insert" if base is None else "n_edit_delete" if None in (l, r) else "n_edit_edit"] += 1
            return base

        def edit(b, name, base, line):
            c = _code(b, doc_id, name)
            return (None if line else "") if c == 0 else base + "!?"[c - 1] if c in (1, 2) else base

        row = [decide(v, edit("L", n, v, False), edit("R", n, v, False)) for n, v in (("lang", lang), ("source", source))]
        merged = []
        for i, x in enumerate(lines):
            merged.append(decide(x, edit("L", i, x, True), edit("R", i, x, True)))
            merged.append(decide(None, *[{3: "!", 4: "?"}.get(_code(b, doc_id, i)) for b in "LR"]))
        whole = "\n".join(x for x in merged if x is not None)
        if gone["L"] or gone["R"]:
            clash = (gone["L"] != gone["R"]) and bool(left.get("R" if gone["L"] else "L"))
            counts = dict.fromkeys(B.COUNTS, 0) | {"n_edit_delete" if clash else "n_clean": 1}
            row, whole = ([lang, source], text) if clash else ([None, None], None)
        out.append((doc_id, *row, whole, *counts.values()))
    for i, found in added.items():
        same = len(set(found)) == 1
        out.append((i, *(found[0] if same else (None, None, None)), int(same), 0, 0, int(not same)))
    return sorted(out, key=repr)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_awkward_rows(spark, clashing, nothing):
    want = plain(sorted({(r[0], r[1] or "", r[2] or "", r[3] or "") for r in AWKWARD}, key=repr))
    assert _rows(B.merge_branches(clashing)) == want
    assert B.merge_branches(nothing).collect() == []


def test_many_documents_and_long_ones(spark):
    draw = random.Random(5)
    docs = [(i, "\n".join(draw.choice(["", "a", "b c", "é"]) for _ in range(draw.choice([0, 1, 2, 3, 9, 30]))), draw.choice(["", "en", None]), draw.choice(["s", "t"])) for i in range(2000)]
    docs += [(5000 + i, "\n".join(map(str, range(n))), "en", "s") for i, n in enumerate((256, 257, 40000, 70000))]
    want = plain(docs)
    assert {k: sum(r[4 + i] for r in want) > 0 for i, k in enumerate(B.COUNTS)} == dict.fromkeys(B.COUNTS, True)
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").repartition(5)
    got = B.merge_branches(df)
    assert _rows(got) == want
    hashes = {r.doc_id: r.text_sha256 for r in B.digest(got).collect()}
    assert all(hashes[r[0]] == (None if r[3] is None else hashlib.sha256(r[3].encode()).hexdigest()) for r in want)


def test_the_join_of_states_is_idempotent_and_free_of_order(spark):
    said = [(1, B.BASE, "x"), (1, B.LEFT, "y"), (1, B.RIGHT, None), (2, B.BASE, "x"), (2, B.LEFT, "y"), (2, B.LEFT, "z"), (3, B.LEFT, "n"), (3, B.RIGHT, "n")]
    want = [(1, "x", 0, 0, 1, 0), (2, "x", 0, 1, 0, 0), (3, "n", 1, 0, 0, 0)]
    for rows in (said, said[::-1], said * 3):
        df = spark.createDataFrame(rows, "k int, branch int, value string").repartition(3)
        assert _rows(B.resolved(B.fold(df, "k")).select("k", "merged", *B.COUNTS)) == want


def test_general_branches(spark):
    """Branches given as tables of changes: a line removed by one and edited by the other, several lines inserted, a column."""
    base = [(7, 0, B.ROW, 0, B.BASE, "", 3), (7, 0, B.COLUMN, 0, B.BASE, "en", None)] + [(7, 0, B.LINE, i, B.BASE, x, None) for i, x in enumerate("abc")]
    changes = [(7, 0, B.LINE, 0, B.LEFT, None, None), (7, 0, B.LINE, 0, B.RIGHT, "A", None), (7, 0, B.GAP, 1, B.RIGHT, "n\nm", None), (7, 0, B.COLUMN, 0, B.LEFT, "de", None), (7, 0, B.LINE, 2, B.RIGHT, None, None)]
    df = spark.createDataFrame(base + changes, "doc_id long, twin long, unit int, pos long, branch int, value string, lines long")
    assert _rows(B.merge(df, ["lang"])) == [(7, 0, "de", "a\nb\nn\nm", 3, 0, 1, 0)]
