"""Streams over the events table, run to their end and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordweave.operators import build
from wordweave.operators.keyed import KeyedTable
from wordweave.plans.graph_queries import graph_stats
from wordweave.plans.log_queries import _SOLVED
from wordweave.plans.registry import GRAPH, LOG, NORM, SQL, query
from wordweave.plans.testbed import from_events, in_files
from wordweave.session import released, shared_dir, written
from wordweave.sources.readers import table
from wordweave.streaming import streams


def _sink(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sinks/{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.file_stream(spark, f"{sf_dir}/events.parquet")


@query(f"WITH {LOG} SELECT id, kind, a, b, status, hops FROM log")
def stream_log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _sink(spark)
    streams.drain(streams.appended(from_events(_events(spark, sf_dir)).drop("created_at"), path))
    return spark.read.parquet(path).drop("batch")


#: Batches that the streams below come in.
BATCHES = 4


def _log_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.file_stream(spark, in_files(table(spark, sf_dir, "events"), "event_id", BATCHES), 1)


@query(f"WITH {LOG}, p AS ({_SOLVED}) SELECT a, b, c, h FROM p")
def stream_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of solved pairs over several batches; each writes the pairs that it changed."""
    path = _sink(spark)
    pairs = KeyedTable(spark, f"{path}/pairs", streams.PAIRS, ["la", "lb"], buckets=16)
    streams.drain(streams.upserted(streams.pair_counts(from_events(_log_batches(spark, sf_dir))), pairs, [F.desc("c")], path))
    return pairs.rows().select("a", "b", "c", "h")


@query(
    f"""WITH {LOG}, r AS (SELECT {NORM.format("a")} AS norm_a, {NORM.format("b")} AS norm_b, a, b, hops, row_number() OVER (PARTITION BY {NORM.format("a")}, {NORM.format("b")} ORDER BY hops, id) AS i FROM log WHERE kind = 'path' AND status = 'ok' AND hops IS NOT NULL)
    SELECT norm_a, norm_b, a, b, hops FROM r WHERE i = 1"""
)
def stream_best_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records over several batches; each writes those that fell."""
    path = _sink(spark)
    best = KeyedTable(spark, f"{path}/records", streams.BEST, ["norm_a", "norm_b"], buckets=16)
    records = streams.best_records(from_events(_log_batches(spark, sf_dir)))
    streams.drain(streams.upserted(records, best, ["hops", "id"], path))
    return best.rows().drop("id")


@query("SELECT DISTINCT user_id FROM events")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _sink(spark)
    streams.drain(streams.appended(streams.first_seen(_events(spark, sf_dir).select("user_id"), "user_id"), path))
    return spark.read.parquet(path).drop("batch")


@query(SQL["graph_full_stats"])
def stream_refreshed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the graph of all texts so far, computed anew with each of two batches of documents."""
    path = _sink(spark)
    source = in_files(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 2)

    def compute(docs: DataFrame) -> DataFrame:
        e = written(build.edges(build.document_texts(docs)), "refreshed-edges")  # read several times
        out = graph_stats(e)
        released(e)
        return out

    streams.drain(streams.refreshed(streams.file_stream(spark, source, 1), compute, path, every=None))
    return streams.latest(spark, f"{path}/result")


def _absorbed(spark: SparkSession, sf_dir: str) -> tuple[KeyedTable, KeyedTable]:
    """The edges and in-degrees after the documents came in several batches."""
    path, buckets = _sink(spark), 32
    source = in_files(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", BATCHES)
    streams.drain(streams.absorbed(build.document_texts(streams.file_stream(spark, source, 1)), path, buckets=buckets))
    return streams.absorbed_tables(spark, path, buckets)


@query(f"WITH RECURSIVE {GRAPH}, span AS (SELECT min(doc_id) AS lo, max(doc_id) AS hi FROM documents), by_batch AS (SELECT src, dst, least(((id - lo) * {BATCHES}) // (hi - lo + 1), {BATCHES} - 1) AS batch, min(rank) AS rank FROM (SELECT id, {NORM.format('head')} AS src, {NORM.format('low')} AS dst, rank FROM nb), span WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL) SELECT src, dst, arg_min(rank, batch)::INT AS rank, min(batch)::BIGINT AS batch FROM by_batch GROUP BY src, dst")
def stream_edges_absorbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges in the batch that brought them first, with their rank there."""
    return _absorbed(spark, sf_dir)[0].rows()


@query(f"WITH RECURSIVE {GRAPH} SELECT dst AS word, count(*) AS indeg FROM edges GROUP BY dst")
def stream_in_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-degrees, kept up by what each batch adds."""
    return _absorbed(spark, sf_dir)[1].rows().select("word", "indeg")


@query("SELECT event_id, (ts - to_hours((user_id % 48)::INT)) < date_trunc('day', ts - INTERVAL 3 HOUR) + INTERVAL 3 HOUR AS due FROM events")
def stream_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a daily job is due at an event's time, if it ran last some hours before."""
    e = table(spark, sf_dir, "events")
    last = F.col("ts") - F.make_dt_interval(hours=(F.col("user_id") % 48).cast("int"))
    return e.select("event_id", streams.due(last, F.col("ts")).alias("due"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL")
def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows in complete mode, which keeps late rows' windows too."""
    path = _sink(spark)
    streams.drain(streams.replaced(streams.event_windows(_events(spark, sf_dir)), path))
    return streams.latest(spark, path).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("v", 4).alias("v"))
