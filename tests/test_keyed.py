"""Keyed tables: each key once, and only the folders that a write changes are written or read."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wordweave.operators import build, search_log
from wordweave.operators.keyed import KeyedTable
from wordweave.plans import log_queries, testbed
from wordweave.plans.graph_queries import graph_usable_edges

RECORD = "norm_a string, norm_b string, hops int, finder string"


def times(path):
    return {str(p): os.stat(p).st_mtime_ns for p in Path(path).rglob("*.parquet") if p.is_file()}


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture
def records(spark, tmp_path):
    out = KeyedTable(spark, str(tmp_path / "records"), RECORD, ["norm_a", "norm_b"], buckets=32)
    out.upsert(spark.createDataFrame([(f"a{i}", "b", 5, "old") for i in range(200)], RECORD), "hops")
    return out


def test_upsert_writes_changed_folders_only(spark, records):
    before = times(records.path)
    new = spark.createDataFrame([("a7", "b", 4, "new"), ("a8", "b", 5, "tie"), ("a9", "b", 6, "worse"), ("a7", "b", 3, "best"), (None, "b", 1, "null")], RECORD)
    changed = records.upsert(new, "hops")
    assert len(changed) <= 2
    after = times(records.path)
    assert {p for p in before if after.get(p) != before[p]} == {p for p in before if any(f"bucket={b}/" in p for b in changed)}
    got = {(r.norm_a, r.hops, r.finder) for r in records.rows().collect()}
    assert got == {(f"a{i}", 5, "old") for i in range(200) if i != 7} | {("a7", 3, "best"), (None, 1, "null")}
    assert records.upsert(new, "hops") == [] and times(records.path) == after  # again: nothing


def test_lookup_reads_its_folders_only(spark, records):
    asked = spark.createDataFrame([("a3", "b"), ("none", "b")], "norm_a string, norm_b string")
    found = records.lookup(asked)
    assert [(r.norm_a, r.hops) for r in found.collect()] == [("a3", 5)]
    assert "PartitionFilters: [" in plan(found) and "bucket" in plan(found).split("PartitionFilters: [")[1].split("]")[0]
    assert len(records.folders(asked)) <= 2 < records.buckets
    assert records.lookup(asked.limit(0)).count() == 0


def test_insert_keeps_what_is_there(spark, records):
    before = times(records.path)
    fresh = records.insert(spark.createDataFrame([("a1", "b", 1, "x"), ("z", "z", 2, "second"), ("z", "z", 1, "first")], RECORD), "hops")
    assert [tuple(r) for r in fresh.collect()] == [("z", "z", 1, "first")]
    after = times(records.path)
    assert all(after[p] == t for p, t in before.items()) and len(after) == len(before) + 1
    assert records.rows().count() == 201


def test_update_and_fill(spark, tmp_path):
    nodes = KeyedTable(spark, str(tmp_path / "nodes"), "key string, word string, ok boolean", ["key"], buckets=16)
    nodes.insert(spark.createDataFrame([(f"k{i}", f"w{i}", None if i % 10 == 0 else True) for i in range(100)], nodes.schema), "word")
    changes = spark.createDataFrame([("k1", False), ("k2", True), ("k3", None), ("gone", False), ("k4", False), ("k4", True)], "key string, ok boolean")
    before = times(nodes.path)
    changed = nodes.update(changes, "ok")
    assert len(changed) == 1 and {p for p, t in before.items() if times(nodes.path).get(p) != t} == {p for p in before if f"bucket={changed[0]}/" in p}
    assert {r.key for r in nodes.rows().filter("ok = false").collect()} == {"k1"}
    assert nodes.update(changes, "ok") == []
    filled = nodes.fill("ok", F.col("word") != "w20")
    assert 0 < len(filled) < 16 and nodes.fill("ok", F.lit(True)) == []
    assert {r.key for r in nodes.rows().filter("not ok").collect()} == {"k1", "k20"} and nodes.rows().filter("ok is null").count() == 0


def test_few_upserts_of_the_log(spark, sf_dir):
    kept, changed = log_queries.upsert_few(spark, sf_dir)
    assert 1 <= len(changed) <= 4


def test_word_index_is_read_by_folder(spark, sf_dir):
    """Words are found by the index: no plan aggregates the nodes, and only the words' folders are read."""
    words = testbed.words(spark, sf_dir)
    one = testbed.nodes(spark, sf_dir).select(F.upper("word").alias("a")).limit(3)
    found = search_log.resolved(one, words, "a")
    assert found.filter("ka is null").count() == 0
    asked = spark.createDataFrame([(r.ka,) for r in found.collect()], "folded string")
    used = words.lookup(asked)
    assert len(words.folders(asked)) <= 3 < words.buckets
    assert "bucket" in plan(used).split("PartitionFilters: [")[1].split("]")[0]
    assert "min(" not in plan(used) and "lower(word" not in plan(used)
    nodes = spark.createDataFrame([("k2", "Jazz"), ("k1", "jazz"), ("k3", "x")], "key string, word string")
    assert {(r.folded, r.key) for r in search_log.folded(nodes).collect()} == {("jazz", "k1"), ("x", "k3")}


def test_config_edges_are_pruned(spark, sf_dir):
    df = graph_usable_edges(spark, sf_dir)
    filters = plan(df).split("PartitionFilters: [")[1].split("]")[0]
    assert "config_id" in filters and "Join" not in plan(df)
    nodes = spark.createDataFrame([("a", True), ("b", None), ("c", False)], "key string, ok boolean")
    e = spark.createDataFrame([(1, "a", "b", 1), (1, "a", "c", 2), (1, "c", "b", 1), (2, "b", "a", 1), (1, "a", "gone", 3)], "config_id int, src string, dst string, rank int")
    stored = build.with_flags(e, nodes)
    assert [(r.src, r.dst) for r in build.usable(stored, 1).collect()] == [("a", "b")]
    assert stored.count() == 4 and build.of_config(stored, 1).count() == 3
