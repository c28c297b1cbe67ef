import gzip
import io
import zipfile

import pytest

from lodestone.sources import config as C
from lodestone.sources import files as S
from tests.conftest import one


def test_jsonl_round_trip_and_torn_line(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (2, None)], "k int, v string")
    S.write_jsonl(df, f"{tmp_path}/out", compress=True)
    assert one(S.read_jsonl(spark, f"{tmp_path}/out", df.schema), "k", "v") == [(1, "a\nb"), (2, None)]
    with pytest.raises(Exception, match="already exists"):
        S.write_jsonl(df, f"{tmp_path}/out")
    (tmp_path / "torn.jsonl").write_text('{"k":1,"v":"x"}\n{"k":2,"v"')
    good, bad = S.read_jsonl_lenient(spark, f"{tmp_path}/torn.jsonl", df.schema)
    assert good.count() == 1 and bad.count() == 1
    with pytest.raises(Exception):
        S.read_jsonl(spark, f"{tmp_path}/torn.jsonl", df.schema).collect()


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿id,q\n1,"x\ny"\n2,z\n'.encode())
    assert one(S.read_csv(spark, f"{tmp_path}/a.csv", {"id", "q"}), "id", "q") == [("1", "x\ny"), ("2", "z")]
    with pytest.raises(ValueError, match="lacks"):
        S.read_csv(spark, f"{tmp_path}/a.csv", {"other"})
    assert one(S.read_csv_lines(spark, f"{tmp_path}/a.csv"), "line", "fields") == [(1, ["id", "q"]), (2, ["1", "x\ny"]), (4, ["2", "z"])]


def test_lines_zip_and_marked_docs(spark, tmp_path):
    (tmp_path / "l.gz").write_bytes(gzip.compress(b"ab\n\ncd"))
    assert one(S.read_lines(spark, f"{tmp_path}/l.gz"), "line", "offset", "text") == [(1, 0, bytearray(b"ab")), (2, 3, bytearray(b"")), (3, 4, bytearray(b"cd"))]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("x/a.jsonl", "{}")
        z.writestr("b.txt", "no")
    (tmp_path / "z.zip").write_bytes(buffer.getvalue())
    assert one(S.read_zip(spark, f"{tmp_path}/z.zip", ".jsonl"), "member") == [("x/a.jsonl",)]
    (tmp_path / "d.xml").write_text('<doc id="1">one</doc>\n<doc id="2" x="y">two\n<doc id="3">three')
    assert one(S.read_marked_docs(spark, f"{tmp_path}/d.xml"), "doc_id", "text") == [("1", "one"), ("2", "two"), ("3", "three")]


def test_manifest(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    before = spark.createDataFrame(S.manifest(spark, f"{tmp_path}/*").collect())
    (tmp_path / "a").write_text("y")
    (tmp_path / "b").write_text("z")
    assert sorted(c for (c,) in one(S.changed(before, S.manifest(spark, f"{tmp_path}/*")), "change")) == ["added", "changed"]


def test_shards(spark, tmp_path):
    (tmp_path / "year=2020").mkdir()
    (tmp_path / "year=2020" / "a.jsonl.gz").write_bytes(gzip.compress(b'{"k":1}\n'))
    assert one(S.read_shards(spark, str(tmp_path), spark.range(1).selectExpr("CAST(id AS INT) k").schema), "k", "year") == [(1, 2020)]


def test_scan_lines_of_split_files(spark, tmp_path):
    """A file that many tasks share gives the numbers and offsets of one that is read as a whole."""
    lines = [("x" * (i * 7 % 60) + "é" * (i % 3)).encode() + (b"\r" if i % 10 == 0 else b"") for i in range(5000)]
    (tmp_path / "a.txt").write_bytes(b"\n".join(lines) + b"\n")
    (tmp_path / "b.txt").write_bytes(b"one\n\ntwo")
    (tmp_path / "c.gz").write_bytes(gzip.compress(b"p\nq\n"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9973")
    try:
        found = S.scan_lines(spark, f"{tmp_path}/*")
        assert found.select("path").distinct().count() == 3 and spark.read.text(f"{tmp_path}/a.txt").rdd.getNumPartitions() > 10
        got = sorted((r.path.rsplit("/", 1)[1], r.line, r.offset, bytes(r.text)) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted((r.path.rsplit("/", 1)[1], r.line, r.offset, bytes(r.text)) for r in S.read_lines(spark, f"{tmp_path}/*").collect())


def test_marked_docs_of_split_files(spark, tmp_path):
    (tmp_path / "d.xml").write_text("".join(f'<doc id="{i}" x="y">\n{"t" * (i % 50)} {i}\n</doc>\n' for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5003")
    try:
        got = {r.doc_id: r.text for r in S.read_marked_docs(spark, f"{tmp_path}/d.xml").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {str(i): f"{'t' * (i % 50)} {i}".strip() for i in range(2000)}


def test_csv_sink_and_packages(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", x'), (2, None)], "k int, v string")
    S.write_csv(df, f"{tmp_path}/csv")
    assert one(S.read_csv(spark, f"{tmp_path}/csv", {"k", "v"}), "k", "v") == [("1", 'a "q", x'), ("2", None)]
    with pytest.raises(Exception, match="already exists"):
        S.write_csv(df, f"{tmp_path}/csv")
    S.write_package({"a": df, "b": df.limit(1)}, f"{tmp_path}/p")
    back = S.read_package(spark, f"{tmp_path}/p", {"a": df.schema, "b": df.schema})
    assert one(back["a"], "k", "v") == one(df, "k", "v") and back["b"].count() == 1
    part = next(p for p in (tmp_path / "p" / "a").glob("part-*") if "q" in p.read_text())
    for sums in (tmp_path / "p" / "a").glob(".*.crc"):  # else the local file system itself complains
        sums.unlink()
    part.write_text(part.read_text().replace("q", "r"))
    with pytest.raises(ValueError, match="changed"):
        S.read_package(spark, f"{tmp_path}/p", {"a": df.schema, "b": df.schema})


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": {"b": 1, "c": {}}, "d": [1, "x"]}')
    config = C.load(spark, f"{tmp_path}/c.json")
    assert C.get(config, "a.b") == 1 and C.get(config, "d") == [1, "x"]
    for path in ("a.x", "a.b.c", "", "d.0"):
        with pytest.raises(KeyError):
            C.get(config, path)
    assert one(C.table(spark, config), "path", "value") == [("a.b", "1"), ("a.c", "{}"), ("d", '[1, "x"]')]
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(ValueError):
        C.load(spark, f"{tmp_path}/l.json")


def test_scratch_folder_must_be_shared_on_a_cluster():
    from types import SimpleNamespace

    from lodestone.sources import scratch

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.shared_dir(cluster)
    assert scratch.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: "file:///x/"))) == "file:///x"


def test_resumed_logs_and_publishing(spark, tmp_path):
    schema = spark.createDataFrame([], "k int, v string").schema
    (tmp_path / "torn.jsonl").write_text('{"k":1,"v":"x"}\n\n{"k":2,"v":"y"}\n{"k":3,"v"')
    assert one(S.read_jsonl_resumed(spark, f"{tmp_path}/torn.jsonl", schema), "k") == [(1,), (2,)]
    (tmp_path / "spoiled.jsonl").write_text('{"k":1,"v":"x"}\n{"k":2,"v"\n{"k":3,"v":"z"}\n')
    with pytest.raises(ValueError, match="line 2"):
        S.read_jsonl_resumed(spark, f"{tmp_path}/spoiled.jsonl", schema)
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    S.publish(df, f"{tmp_path}/there")
    assert one(S.read_jsonl(spark, f"{tmp_path}/there", schema), "k", "v") == [(1, "a")]
    with pytest.raises(FileExistsError):
        S.publish(df, f"{tmp_path}/there")

    def fails(df, path):
        S.write_jsonl(df, path)
        raise OSError("cut off")

    with pytest.raises(OSError):
        S.publish(df, f"{tmp_path}/never", fails)
    assert not (tmp_path / "never").exists()


def test_package_digests_by_many_tasks(spark, tmp_path, monkeypatch):
    """Files are bounded in rows, and no task digests all of them; only their digests come together."""
    monkeypatch.setattr(S, "PACKAGE_ROWS", 25)
    df = spark.range(0, 400, 1, 8).selectExpr("id AS k", "repeat('x', 100) AS v")
    context = spark.sparkContext
    store, none = context._jsc.sc().statusStore(), context._gateway.new_array(context._jvm.double, 0)
    stages = lambda: {x.stageId(): x for x in map(store.stageList(None, False, False, none, None).apply, range(store.stageList(None, False, False, none, None).size()))}
    before = stages()
    S.write_package({"a": df}, f"{tmp_path}/p")
    read = [x for k, x in stages().items() if k not in before and x.inputRecords() == 16]
    assert len(read) == 1 and read[0].numTasks() > 1
    assert len(list((tmp_path / "p" / "manifest").glob("part-*"))) == 1
    assert S.read_package(spark, f"{tmp_path}/p", {"a": df.schema})["a"].count() == 400
