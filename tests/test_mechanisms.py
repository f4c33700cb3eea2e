"""Logs over many tasks and splits, stored index, fuzzy candidates, header sweep, commits of several tables, cache."""

import hashlib
import json
import random
import string
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from proofline.operators import audit, index, layout, quality, retrieval, shelf
from proofline.sources import tables


def chain(n, log=0):
    link, out = audit.GENESIS, []
    for i in range(n):
        line = json.dumps({"i": i, "prev_sha256": link})
        out.append([log, i * 3, line, link])
        link = hashlib.sha256(line.encode()).hexdigest()
    return out


def broken(spark, rows):
    df = spark.createDataFrame(rows, "log int, n int, line string, prev_sha256 string").repartition(5)
    return {r.log: (r.n, r.broken_at) for r in audit.breaks(df, "log", "n").collect()}


def test_one_long_log_on_many_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        good = chain(40) + chain(3, 1)
        df = spark.createDataFrame(good, "log int, n int, line string, prev_sha256 string")
        dealt = df.repartitionByRange("log", "n").select(F.spark_partition_id().alias("p")).distinct().count()
        assert dealt > 3 and broken(spark, good) == {0: (40, None), 1: (3, None)}
        for i in range(39):  # a changed line, wherever ranges end
            bad = [list(r) for r in chain(40)]
            bad[i][2] = bad[i][2].replace('"i"', '"j"')
            assert broken(spark, bad) == {0: (40, i + 2)} if i % 6 == 0 else True
        cut = [r for r in chain(40) if r[1] != 60]
        assert broken(spark, cut) == {0: (39, 21)}
        assert broken(spark, [[0, 0, "{no", audit.GENESIS], [0, 1, " ", None]]) == {0: (1, 1)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_file_read_by_several_tasks(spark, tmp_path):
    lines = [r[2] for r in chain(300)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text("\r\n".join(lines[:5]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = tables.audit_log(spark, f"file://{tmp_path}")
        assert spark.read.text(f"file://{tmp_path}").rdd.getNumPartitions() > 5
        got = {}
        for r in rows.collect():
            got.setdefault(r.file[-7:], {})[r.nth] = r.line
        assert [got["a.jsonl"][i] for i in range(300)] == lines and [got["b.jsonl"][i] for i in range(5)] == lines[:5]
        assert {r.n: r.broken_at for r in audit.breaks(rows, "file", "nth").collect()} == {300: None, 5: None}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_stored_index_gives_what_a_scan_gives(spark, tmp_path, monkeypatch):
    r = random.Random(4)
    words = [f"w{int(r.paretovariate(0.8))}" for _ in range(6000)]
    docs = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 60)))) for i in range(400)] + [(400, None), (401, "")], "doc_id int, text string")
    questions = spark.createDataFrame([(1, "w1 w2"), (2, "w3"), (3, "w5 w9 w1 w40"), (4, "none such"), (5, "w1 w1 w7 a")], "query_id int, query string")
    monkeypatch.setattr(index, "BLOCK", 4)
    monkeypatch.setattr(index, "SPAN", 50)
    path = f"file://{tmp_path}/index"
    index.write(docs, path)
    for k in (1, 3, 50):
        want = sorted(map(tuple, retrieval.bm25(docs, questions, k=k).collect()))
        assert sorted(map(tuple, index.search(spark, path, questions, k=k).collect())) == want and want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_match_of_many_words_and_choices(spark):
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcd") if r.random() < 0.7 else r.choice(string.ascii_lowercase) for _ in range(n))
    choices = sorted({word(r.randrange(1, 22)) for _ in range(250)})
    words = {word(r.randrange(1, 12)) for _ in range(100)}
    for c in r.sample(choices, 160):
        w = list(c)
        for _ in range(r.randrange(0, 4)):
            at = r.randrange(len(w) + 1)
            w[at : at + r.randrange(0, 2)] = r.choice(["", "a", "z", "b"])
        words.add("".join(w))
    want = set()
    for w in words:
        scored = sorted(((SequenceMatcher(None, w, c).ratio(), c) for c in choices), reverse=True)
        (best, choice), (second, _) = scored[:2]
        if w in choices:
            want.add((w, w, "exact"))
        elif (best >= 0.88 or len(w) >= 5 and edits(w, choice) <= 1) and best - second >= 0.04:
            want.add((w, choice, "alike" if best >= 0.88 else "one edit"))
    table = lambda some, name: spark.createDataFrame([(x,) for x in some] + [(None,)], f"{name} string")
    found = quality.closest(table(words, "word"), table(choices, "choice"))
    assert {tuple(x) for x in found.collect()} == want and len({h for _, _, h in want}) == 3


def brute_line(rows):
    best = None
    for a in rows:
        for b in rows:
            if abs(b[3] - a[3]) >= 100 and abs((b[4] - a[4]) / (b[3] - a[3])) <= 0.1:
                slope = (b[4] - a[4]) / (b[3] - a[3])
                on = [w for w in rows if abs(w[4] - (a[4] + slope * (w[3] - a[3]))) <= 15.0]
                one = (-len({w[1] for w in on}), -sum(w[2] for w in on), min(on)[4], a[0], b[0])
                best = one if best is None or one < best else best
    return None if best is None else (-best[0], -best[1], best[2])


@pytest.mark.parametrize("few", [0, 8, 24, 1000])
def test_header_lines_by_pairs_and_by_a_sweep(spark, monkeypatch, few):
    monkeypatch.setattr(layout, "FEW", few)
    r = random.Random(2)
    pages = {}
    for p in range(12):
        n = r.choice([1, 2, 8, 25])
        pages[p] = [(i, r.choice("abcde"), r.random() < 0.5, float(r.randrange(0, 6) * 60), float(r.choice([10, 20, 25, 40, 55, 70]))) for i in range(n)]
    table = spark.createDataFrame([(p, *w) for p, rows in pages.items() for w in rows], "page int, id int, field string, is_exact boolean, x double, y double")
    got = {x.page: (x.fields, x.exact, x.top) for x in layout.header_lines(table, "page").collect()}
    assert got == {p: line for p, rows in pages.items() if (line := brute_line(rows))}
    if few > 24:
        return
    many = spark.createDataFrame([(1, i, f"f{i % 9}", True, float(i % 50 * 20), float(i // 50 * 40)) for i in range(1000)], "page int, id int, field string, is_exact boolean, x double, y double")
    assert layout.header_lines(many, "page").collect()[0].fields == 9


def test_documents_are_replaced_in_all_tables_or_in_none(spark, tmp_path):
    path = f"file://{tmp_path}/shelf"
    reports = lambda some: spark.createDataFrame(some, "doc_id string, place string")
    rows = lambda some: spark.createDataFrame(some, "doc_id string, value int")
    assert shelf.read(spark, path, "reports") is None
    assert shelf.ingest(spark, path, {"reports": reports([("a", "x"), ("b", "y"), (None, "z")]), "readings": rows([("a", 1), ("a", 2), ("b", 3)])}, buckets=4) == 1
    assert shelf.ingest(spark, path, {"reports": reports([("a", "new")]), "readings": rows([])}, buckets=4) == 2
    held = lambda name: sorted(map(tuple, shelf.read(spark, path, name).collect()), key=str)
    assert held("reports") == sorted([("a", "new"), ("b", "y"), (None, "z")], key=str) and held("readings") == [("b", 3)]
    before = shelf.manifest(spark, path)
    broken = rows([("b", 1)]).withColumn("value", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        shelf.ingest(spark, path, {"reports": reports([("b", "bad")]), "readings": broken}, buckets=4)
    assert shelf.manifest(spark, path) == before and held("readings") == [("b", 3)]
    # another writer was first
    overtaken = shelf.manifest
    try:
        shelf.manifest = lambda *_: (1, {})
        with pytest.raises(Exception, match="exist"):
            shelf.ingest(spark, path, {"reports": reports([("c", "late")])}, buckets=4)
    finally:
        shelf.manifest = overtaken
    assert shelf.manifest(spark, path) == before


def test_a_bucket_is_written_by_as_many_tasks_as_its_rows_ask_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shelf, "NARROW", 50)
    path, rows = f"file://{tmp_path}/shelf", spark.range(1000).withColumnRenamed("id", "doc_id")
    for number in (1, 2):
        assert shelf.ingest(spark, path, {"reports": rows}, buckets=4, rows=1000) == number
        found = shelf.read(spark, path, "reports").groupBy(F.input_file_name()).count().collect()
        assert sum(r["count"] for r in found) == 1000 and len(found) == 20 and max(r["count"] for r in found) < 100
    assert len(shelf.manifest(spark, path)[1]["reports"]["buckets"]) == 4


def test_a_second_run_computes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    wanted = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1), (None, 3)], "key string, x int")
    double = lambda rows: rows.select("key", (F.col("x") * 2).alias("y"))
    never = lambda rows: rows.select("key", F.raise_error(F.lit("computed")).cast("int").alias("y"))
    want = [("a", 2), ("b", 4)]
    assert sorted(map(tuple, shelf.cached(wanted, path, "key", double).collect())) == want
    assert sorted(map(tuple, shelf.cached(wanted, path, "key", never).collect())) == want
    more = wanted.unionByName(spark.createDataFrame([("c", 5)], "key string, x int"))
    assert sorted(map(tuple, shelf.cached(more, path, "key", double).collect())) == [*want, ("c", 10)]
    # two runs that met, and one that broke off
    spark.createDataFrame([("a", 2)], "key string, y int").write.parquet(f"{path}/batch-0")
    (tmp_path / "cache" / "batch-1").mkdir()
    assert sorted(map(tuple, shelf.cached(more, path, "key", never).collect())) == [*want, ("c", 10)]
    assert shelf.cached(wanted.filter("false"), f"file://{tmp_path}/none", "key", double).count() == 0
