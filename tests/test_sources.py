"""Readers and writers on files of their own."""

import json

from pyspark.sql import functions as F

from proofline.operators import audit, selection
from proofline.sources import registry, sinks, tables


def test_chained_log_grows_and_verifies(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    batch = lambda a, b: spark.createDataFrame([(i, json.dumps({"e": i})) for i in range(a, b)], "n int, payload string")
    assert sinks.append_chained(batch(0, 3), path, "n") == 3
    assert sinks.append_chained(batch(3, 5), path, "n") == 5
    lines = spark.read.parquet(path).withColumn("log", F.lit(1))
    assert audit.breaks(lines, "log", "nth").first().broken_at is None
    assert [json.loads(r.line)["prev_sha256"] for r in lines.orderBy("nth").collect()] == [r.prev_sha256 for r in lines.orderBy("nth").collect()]


def test_audit_log_of_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"prev_sha256": "' + "0" * 64 + '"}\n\n{"x": 1}\n')
    rows = tables.audit_log(spark, f"file://{tmp_path}/a.jsonl")
    got = audit.breaks(rows, "file", "nth").first()
    assert (got.n, got.broken_at) == (2, 2)


def test_rebuild_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    sinks.rebuild(df, f"file://{tmp_path}/p")
    sinks.rebuild(df, f"file://{tmp_path}/p")
    assert spark.read.parquet(f"file://{tmp_path}/p").count() == 1
    sinks.stage_json(df, f"file://{tmp_path}/j")
    assert "".join(p.read_text() for p in (tmp_path / "j").glob("part-*")).strip() == '{"a":1,"b":null}'


def test_catalogue_and_truth(spark, tmp_path):
    (tmp_path / "r1.json").write_text('{"doc_id": "r1", "readings": [{"cml_id": "1", "current_mm": 11.320}]}')
    wanted = spark.createDataFrame([("r1",), ("r2",)], "name string")
    got = {r.name: r.path for r in tables.catalogue(spark, f"file://{tmp_path}", wanted).collect()}
    assert got["r1"].endswith("r1.json") and got["r2"] is None
    truth = tables.ground_truth(spark, f"file://{tmp_path}/r1.json")
    assert truth.select(F.explode("readings.current_mm")).first()[0] == "11.320"


def test_registry(spark):
    text = json.dumps({"tasks": {"read": {"gate": {"wrong": 0, "share": 0.9, "ready": True, "secs_max": 5}}}, "models": {"a": {"results": {"read": {"wrong": 0, "share": 0.95, "ready": True, "secs_max": 4}}}, "b": {"results": {"read": {"wrong": 0, "share": 0.95, "ready": True, "secs_max": 6}}}, "c": {"results": {"read": {"wrong": 1}}}, "d": {}}})
    found, sha = registry.load(text)
    gates, results = registry.tables(spark, found)
    assert len(sha) == 64
    assert {(r.model, r.key, r.why) for r in selection.gate_failures(results, gates).collect()} == {("b", "secs_max", "fails"), ("c", "wrong", "fails")}


def test_registries_in_rows_give_the_tables_of_each(spark):
    text = '{"tasks": {"t": {"gate": {"b": true, "f": 2.50, "i": 3}}, "u": {}}, "models": {"m": {"results": {"t": {"b": false, "f": 1e2, "note": "x", "list": [1]}}}, "n": {}}}'
    one = registry.tables(spark, registry.load(text)[0])
    many = registry.tables_of(spark.createDataFrame([(1, text), (2, "{}"), (3, None)], "k long, text string"), "k")
    for a, b in zip(one, many, strict=True):
        # YAML reads 1e2 as text; JSON has it as a number
        assert {tuple(r) for r in b.filter("key <> 'f'").drop("k").collect()} == {tuple(r) for r in a.filter("key <> 'f'").collect()}
    assert [(r.key, r.ord, r.kind, r.want) for r in many[0].orderBy("ord").collect()] == [("b", 0, "bool", 1.0), ("f", 1, "float", 2.5), ("i", 2, "int", 3.0)]
    assert {(r.key, r.have) for r in many[1].collect()} == {("b", 0.0), ("f", 100.0)}
