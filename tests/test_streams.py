"""Streams that are stopped and started again, and the daily schedule."""

from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from wordweave.operators import build
from wordweave.operators.keyed import KeyedTable
from wordweave.streaming import streams


def files(path):
    return {str(p) for p in Path(path).rglob("*.parquet") if p.is_file()}


def add(spark, path, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}")


def test_started_again_goes_on(spark, tmp_path):
    source, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    add(spark, source, [(1, "a"), (2, "b")], "id long, kind string", "one.parquet")
    schema = spark.read.parquet(f"{source}/*").schema
    stream = lambda: spark.readStream.schema(schema).parquet(f"{source}/*")
    streams.drain(streams.appended(stream(), sink))
    add(spark, source, [(3, "a")], "id long, kind string", "two.parquet")
    streams.drain(streams.appended(stream(), sink))
    rows = spark.read.parquet(sink).collect()
    assert sorted((r.id, r.batch) for r in rows) == [(1, 0), (2, 0), (3, 1)]


def test_statistics_of_the_whole_table(spark, tmp_path):
    source, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    compute = lambda df: df.agg(F.count_distinct("kind").alias("kinds"), F.count(F.lit(1)).alias("n"))
    for i, rows in enumerate([[("a",), ("b",)], [("a",), ("c",)]]):
        add(spark, source, rows, "kind string", f"{i}.parquet")
        stream = spark.readStream.schema("kind string").parquet(f"{source}/*")
        streams.drain(streams.refreshed(stream, compute, sink, every=None))
        got = streams.latest(spark, f"{sink}/result").first()
        assert (got.kinds, got.n) == ((2, 2), (3, 4))[i]


def test_absorbed_edges_keep_their_first_rank(spark, tmp_path):
    source, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    for i, text in enumerate(["jazz band blues", "jazz blues soul band", "rock soul"]):
        add(spark, source, [(i, text)], "doc_id long, text string", f"{i}.parquet")
        stream = build.document_texts(spark.readStream.schema("doc_id long, text string").parquet(f"{source}/*"))
        streams.drain(streams.absorbed(stream, sink, buckets=8))
    edges, degrees = streams.absorbed_tables(spark, sink, 8)
    got = {(r.src, r.dst): (r["rank"], r.batch) for r in edges.rows().collect()}
    assert got == {("jazz", "band"): (1, 0), ("jazz", "blues"): (2, 0), ("jazz", "soul"): (2, 1), ("rock", "soul"): (1, 2)}
    assert {(r.word, r.indeg, r.batch) for r in degrees.rows().collect()} == {("band", 1, 0), ("blues", 1, 0), ("soul", 2, 2)}


def test_a_batch_meets_its_own_folders_only(spark, tmp_path):
    """Each batch brings one source: one folder of edges gets files, and a batch that is run again changes nothing."""
    edges, degrees = streams.absorbed_tables(spark, f"{tmp_path}/out", 64)
    for i in range(12):
        texts = spark.createDataFrame([(i, f"head{i}", f"head{i} shared own{i}")], "id long, head string, text string")
        before = files(f"{tmp_path}/out/edges")
        for _ in range(2):
            fresh = edges.insert(build.edges(texts).withColumn("batch", F.lit(i).cast("long")), "rank")
        assert fresh.count() == 0
        own = edges.rows(edges.folders(texts.select(F.col("head").alias("src")))).filter(F.col("batch") == i)
        for _ in range(2):
            degrees.add(own.groupBy(F.col("dst").alias("word")).agg(F.count(F.lit(1)).alias("indeg")), "indeg", i)
        new = files(f"{tmp_path}/out/edges") - before
        assert {x.split("bucket=")[1].split("/")[0] for x in new} == {str(edges.folders(texts.select(F.col("head").alias("src")))[0])}
    assert {r.word: r.indeg for r in degrees.rows().collect()} == {"shared": 12, **{f"own{i}": 1 for i in range(12)}}


def test_records_fall_over_batches(spark, tmp_path):
    source, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = [[(1, "path", "A", "b", "ok", 5), (2, "path", "c", "d", "ok", 4)], [(3, "path", "a", "B", "ok", 5), (4, "path", "x", "y", None, None)], [(5, "path", "a", "b", "ok", 3)]]
    best = KeyedTable(spark, f"{sink}/best", streams.BEST, ["norm_a", "norm_b"], buckets=16)
    counts = KeyedTable(spark, f"{sink}/counts", streams.PAIRS, ["la", "lb"], buckets=16)
    seen = []
    for i, part in enumerate(rows):
        add(spark, source, part, "id long, kind string, a string, b string, status string, hops int", f"{i}.parquet")
        stream = lambda: spark.readStream.schema("id long, kind string, a string, b string, status string, hops int").parquet(f"{source}/*")
        before = files(f"{sink}/best")
        streams.drain(streams.upserted(streams.best_records(stream()), best, ["hops", "id"], f"{sink}/one"))
        streams.drain(streams.upserted(streams.pair_counts(stream()), counts, [F.desc("c")], f"{sink}/two"))
        seen.append(len(files(f"{sink}/best") - before))
    assert {(r.norm_a, r.norm_b, r.hops, r.id, r.a) for r in best.rows().collect()} == {("a", "b", 3, 5, "a"), ("c", "d", 4, 2, "c")}
    assert {(r.la, r.c, r.h, r.a) for r in counts.rows().collect()} == {("a", 3, 3, "a"), ("c", 1, 4, "c")}
    assert seen[1:] == [0, 1]  # equal hops write nothing, a record that falls writes its folder


def test_schedule_catches_up(spark, tmp_path):
    ran = []
    at = lambda d, h: datetime(2026, 1, d, h)
    times = [at(1, 2), at(1, 3), at(1, 23), at(2, 2), at(2, 4), at(6, 1), at(6, 2), at(6, 3)]
    for now in times:
        streams.scheduled(spark, str(tmp_path / "job"), now, lambda now=now: ran.append(now))
    assert ran == [at(1, 2), at(1, 3), at(2, 4), at(6, 1), at(6, 3)]


def test_refreshed_keeps_a_batch_in_as_many_files_as_cores(spark, tmp_path):
    source, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    add(spark, source, [(i, f"w{i}") for i in range(40)], "id long, text string", "a")
    streams.drain(streams.refreshed(streams.file_stream(spark, source), lambda rows: rows.agg(F.count(F.lit(1)).alias("n")), sink, every=None))
    assert streams.latest(spark, f"{sink}/result").first().n == 40
    assert len(files(f"{sink}/table/batch=0")) == spark.sparkContext.defaultParallelism
