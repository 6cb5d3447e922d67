"""Readers, writers and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from annolith.operators import checks
from annolith.sources import files, lines
from annolith.streaming import ledger as stream

SCHEMA = StructType([StructField("name", StringType()), StructField("x", DoubleType())])


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('name,x\n"a,b",1.5\nc,\n', encoding="utf-8")
    rows = files.csv_table(spark, str(p), SCHEMA)
    assert [(r.name, r.x) for r in rows.collect()] == [("a,b", 1.5), ("c", None)]
    assert sorted((r.source_row, r.name) for r in lines.csv_records(spark, str(p), SCHEMA).collect()) == [(2, "a,b"), (3, "c")]
    with pytest.raises(ValueError):
        files.csv_table(spark, str(p), StructType(SCHEMA.fields[::-1]))


def test_jsonl_modes(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"name": "a", "x": 1}\n\n{"name": "b", "x"\n')
    assert files.jsonl(spark, str(p), SCHEMA, "tolerant").count() == 1
    assert files.jsonl(spark, str(p), SCHEMA, "collect").where(F.col(files.CORRUPT).isNotNull()).cache().count() == 1
    assert files.blank_lines(spark, str(p)).first().blank == 1
    with pytest.raises(Exception):
        files.jsonl(spark, str(p), SCHEMA, "strict").collect()


def test_json_shapes(spark, tmp_path):
    rows = [{"name": "a", "x": 1.0}, {"name": "b", "x": 2.0}]
    texts = [json.dumps(rows), json.dumps({"annotations": rows}), json.dumps(rows[0]), "\n".join(map(json.dumps, rows))]
    for i, t in enumerate(texts):
        p = tmp_path / f"{i}.json"
        p.write_text(t)
        assert [r.name for r in files.json_records(spark, str(p), SCHEMA).collect()] == (["a"] if i == 2 else ["a", "b"])


def test_publish_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("b", None)], SCHEMA)
    files.publish(rows, str(tmp_path / "out"))
    assert checks.same_rows(spark.read.parquet(str(tmp_path / "out")), rows)
    with pytest.raises(FileExistsError):
        files.publish(rows, str(tmp_path / "out"))
    (tmp_path / "m").mkdir()
    for n in ("b.txt", "A.txt"):
        (tmp_path / "m" / n).write_text(n)
    assert [r.name for r in files.manifest(spark, str(tmp_path / "m")).orderBy("index").collect()] == ["A.txt", "b.txt"]
    assert len(files.collection_hash(files.manifest(spark, str(tmp_path / "m"))).first().collection) == 64
    assert "| a | 1.00 |" in files.markdown(rows, {"x": "{:.2f}"})


def test_audit_and_checked_join(spark):
    left = spark.createDataFrame([(1,), (2,)], "k bigint")
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k bigint, v string")
    with pytest.raises(Exception):
        checks.checked_join(left, twice, ["k"]).collect()
    bad = checks.audits(checks.unique_key(twice, ["k"], "key"), checks.orphans(left, twice, ["k"], "parent"))
    assert {r.check: r.affected_rows for r in bad.collect()} == {"key": 2, "parent": 1}
    with pytest.raises(Exception):
        checks.require(bad).collect()


def test_stream_resumes(spark, tmp_path):
    schema = StructType([StructField("task", LongType()), StructField("ts", StringType())])
    rows = lambda *ids: spark.createDataFrame([(i, "2024-01-01 00:00:00") for i in ids], "task bigint, ts string").withColumn("ts", F.to_timestamp("ts"))
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    rows(1, 2, 2).write.parquet(src)
    kind = spark.read.parquet(src).schema
    for more in ((), (2, 3)):
        if more:
            rows(*more).write.mode("append").parquet(src)
        stream.run_available(stream.done_once(stream.ledger_stream(spark, src, kind), "task", "ts"), out, ck)
    assert sorted(r.task for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    assert schema.names == ["task", "ts"]
