"""Files read by many tasks each, against the standard library's readers."""

import csv
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.sources import split as P
from tests.conftest import one


def _reference(data: str):
    reader, out, start = csv.reader(io.StringIO(data.removeprefix("﻿"), newline="")), [], 1
    for fields in reader:
        out.append((start, fields))
        start = reader.line_num + 1
    return out


def _random_csv(draw, rows):
    cell = lambda: draw.choice(["", "a", 'say ""x""', "two\nlines", "\n\n", "c,d", "tail\r", "é" * 5, '""'])
    lines = []
    for _ in range(rows):
        cells = [(f'"{c}"' if draw.random() < 0.3 or any(x in c for x in ',\n"\r') else c) for c in (cell() for _ in range(draw.randint(1, 4)))]
        if draw.random() < 0.1:
            cells.append('not"quoted"')
        lines.append(",".join(cells) + draw.choice(["\n", "\r\n"]))
    return "﻿" + "".join(lines)


@pytest.mark.parametrize("size", [37, 150, 1 << 20])
def test_csv_records_across_stretches(spark, tmp_path, size):
    draw, texts = random.Random(size), {}
    for k in range(3):
        texts[f"f{k}.csv"] = _random_csv(draw, 120) + ('"open\nto the end' if k == 1 else "")
        (tmp_path / f"f{k}.csv").write_bytes(texts[f"f{k}.csv"].encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = P.read_csv_records(spark, str(tmp_path)).withColumn("file", F.substring_index("path", "/", -1))
        got = one(df, "file", "line", "fields")
        assert size > 1000 or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted([(f, n, fields) for f, text in texts.items() for n, fields in _reference(text)], key=repr)


def test_csv_of_one_cell_in_many_stretches(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h\n"' + "x\n" * 500 + '"\nlast\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        assert one(P.read_csv_records(spark, f"{tmp_path}/a.csv"), "line", "fields") == [(1, ["h"]), (2, ["x\n" * 500]), (503, ["last"])]
        (tmp_path / "none.csv").write_text("")
        assert P.read_csv_records(spark, f"{tmp_path}/none.csv").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _archive(members, method=zipfile.ZIP_DEFLATED):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", method) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return buffer.getvalue()


@pytest.mark.parametrize("method", [zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED])
def test_zip_members_by_task(spark, tmp_path, method):
    members = {f"d/{i}.jsonl": "".join(f"{i} {k} é\r\n" for k in range(i * 700)) + ("torn" if i % 2 else "") for i in range(5)} | {"other.txt": "no", "d/": ""}
    (tmp_path / "a.zip").write_bytes(_archive(members, method))
    (tmp_path / "b.zip").write_bytes(_archive({"x.jsonl": "1\n\n3"}, method))
    df = P.read_zip_lines(spark, str(tmp_path), ".jsonl", 1)
    assert df.rdd.getNumPartitions() == 6
    want = [(n, k, line) for n, text in members.items() if n.endswith(".jsonl") for k, line in enumerate(text.replace("\r", "").splitlines(), 1)]
    assert one(df, "member", "line", "text") == sorted([*want, ("x.jsonl", 1, "1"), ("x.jsonl", 2, ""), ("x.jsonl", 3, "3")], key=repr)
    (tmp_path / "none").mkdir()
    assert P.read_zip_lines(spark, f"{tmp_path}/none").count() == 0


def test_damaged_archives_raise(spark, tmp_path):
    data = bytearray(_archive({"a": "some text that is stored"}, zipfile.ZIP_STORED))
    data[data.index(b"stored")] ^= 1
    (tmp_path / "a.zip").write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        P.read_zip_lines(spark, f"{tmp_path}/a.zip").collect()


def test_zip_round_trip(spark, tmp_path):
    rows = [(f"m{i % 7}", f"{i} \U0001f600") for i in range(5000)]
    df = spark.createDataFrame(rows, "m string, t string").repartition(4, "m").sortWithinPartitions("m")
    P.write_zip(df, f"{tmp_path}/z", "m", "t")
    got = P.read_zip_lines(spark, f"file:{tmp_path}/z")
    assert one(got, "member", "text") == sorted(rows, key=repr)
