"""Structured Streaming forms of what changes while a graph is in use.

Every function takes a streaming frame and starts a query whose sink can be read as a table;
`drain` runs one over all that is there. A batch that is run again after a failure changes
nothing twice: sinks by batch number replace a batch's rows, keyed ones find the keys that are
there, or the batch that a key had last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from wordweave.functions.text import norm
from wordweave.operators import build
from wordweave.operators.keyed import KeyedTable
from wordweave.session import deleted, released, ship, written

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Heavy statistics are computed anew this often.
REFRESH = "600 seconds"


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of the Parquet files at a path, with their own schema; oldest first. The path may also be one file, which takes a glob that names it alone."""
    schema = spark.read.option("recursiveFileLookup", True).parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).parquet(f"{path[:-1]}[{path[-1]}]")


def _start(stream: DataFrame, path: str, mode: str, each: Callable[[DataFrame, int], None], every: str | None) -> StreamingQuery:
    """The checkpoint lies with the sink, hidden from its readers: a query that is started again goes on where it was, under the next batch number."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{path}/_checkpoint")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def drain(query: StreamingQuery) -> None:
    """Waits for a query that takes what is there to end, and passes its failure on."""
    query.awaitTermination()


def appended(stream: DataFrame, path: str, every: str | None = None) -> StreamingQuery:
    """Appends every batch under path/batch=N: edges absorbed, or search events logged."""

    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return _start(stream, path, "append", each, every)


def _table(spark: SparkSession, path: str, n: int, schema: StructType) -> DataFrame:
    """The rows of the batches before n."""
    return spark.read.schema(schema.add("batch", "long")).option("basePath", path).parquet(f"{path}/batch=*").filter(F.col("batch") < n).drop("batch") if n else spark.createDataFrame([], schema)


EDGES, IN_DEGREES = "src string, dst string, rank int, batch long", "word string, indeg long, batch long"


def absorbed_tables(spark: SparkSession, path: str, buckets: int = 256) -> tuple[KeyedTable, KeyedTable]:
    """The edges, by src, and the in-degrees, by word, that absorbed() keeps up."""
    return KeyedTable(spark, f"{path}/edges", EDGES, ["src", "dst"], ["src"], buckets), KeyedTable(spark, f"{path}/in-degrees", IN_DEGREES, ["word"], buckets=buckets)


def absorbed(stream: DataFrame, path: str, every: str | None = None, buckets: int = 256) -> StreamingQuery:
    """Texts (id, head, text) as they come, as edges that aren't there yet: a pair's first rank stays, nothing is changed or taken back.

    A batch reads the keys of the folders that its own sources fall in, appends what is new, and
    adds as many to the in-degrees of the targets; other folders are neither read nor written.
    """

    def each(batch: DataFrame, n: int) -> None:
        edges, degrees = absorbed_tables(batch.sparkSession, path, buckets)
        new = written(build.edges(batch).withColumn("batch", F.lit(n).cast("long")), "absorbed")
        edges.insert(new, "rank")
        own = edges.rows(edges.folders(new.select("src"))).filter(F.col("batch") == n)  # also what a run that failed has appended
        degrees.add(own.groupBy(F.col("dst").alias("word")).agg(F.count(F.lit(1)).alias("indeg")), "indeg", n)
        released(new)

    return _start(stream, path, "append", each, every)


def upserted(stream: DataFrame, table: KeyedTable, order: Sequence[Column | str], path: str, every: str | None = None) -> StreamingQuery:
    """What each batch changed of a stream's results, into a keyed table: of old and new rows of a key the first by `order` stays. The checkpoint lies at path."""

    def each(batch: DataFrame, n: int) -> None:
        table.upsert(batch, *order)

    return _start(stream, path, "update", each, every)


def replaced(stream: DataFrame, path: str, every: str | None = None) -> StreamingQuery:
    """Writes a whole result anew with every batch, under path/batch=N: the last one holds, the one before it stays for those who read it, older ones go."""

    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
        deleted(batch.sparkSession, f"{path}/batch={n - 2}")

    return _start(stream, path, "complete", each, every)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last batch's result."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), "batch").drop("batch")  # one row


PAIRS = "la string, lb string, a string, b string, c long, h int, last long"
BEST = "norm_a string, norm_b string, a string, b string, hops int, id long"


def pair_counts(log: DataFrame) -> DataFrame:
    """PAIRS: solved pairs with their rows, fewest hops and newest spelling. In update mode a batch gives the pairs that it has rows of."""
    rows = log.filter("kind = 'path' and status = 'ok'")
    return rows.groupBy(F.lower("a").alias("la"), F.lower("b").alias("lb")).agg(F.max_by("a", "id").alias("a"), F.max_by("b", "id").alias("b"), F.count(F.lit(1)).alias("c"), F.min("hops").alias("h"), F.max("id").alias("last"))


class BestSoFar(StatefulProcessor):
    """The earliest row of fewest hops of a pair; a batch gives it only where it is better than what the state holds."""

    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "hops int", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        known = self.best.get() if self.best.exists() else None
        first = None
        for part in rows:
            row = part.sort_values(["hops", "id"]).iloc[0]
            if first is None or (row["hops"], row["id"]) < (first["hops"], first["id"]):
                first = row
        if first is not None and (known is None or first["hops"] < known[0]):
            self.best.update((int(first["hops"]),))
            yield pd.DataFrame({"norm_a": [key[0]], "norm_b": [key[1]], "a": [first["a"]], "b": [first["b"]], "hops": [int(first["hops"])], "id": [int(first["id"])]})

    def close(self) -> None:
        pass


def best_records(log: DataFrame, keep: timedelta | None = None) -> DataFrame:
    """BEST: records as they fall, in update mode: a record falls to strictly fewer hops only.

    `keep`: how long a pair's state stays without a new record, for queries with a trigger (one
    that takes what is there would wait for its states to expire); the keyed table that the
    records go into knows older ones too, so a pair whose state has gone loses none.
    """
    ship(log.sparkSession)
    log.sparkSession.conf.set(PROVIDER, ROCKS)  # states of single keys, which this operator needs
    rows = log.filter("kind = 'path' and status = 'ok' and hops is not null").select(norm(F.col("a")).alias("norm_a"), norm(F.col("b")).alias("norm_b"), "a", "b", "hops", "id")
    processor = BestSoFar(int(keep.total_seconds() * 1000) if keep else None)
    return rows.groupBy("norm_a", "norm_b").transformWithStateInPandas(processor, StructType.fromDDL(BEST), "Update", "ProcessingTime" if keep else "None")


def first_seen(rows: DataFrame, key: str) -> DataFrame:
    """Each key once, whichever batch brings it first. Its state holds every key that there was; absorbed() looks them up in the table instead."""
    return rows.dropDuplicates([key])


def refreshed(stream: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, every: str | None = REFRESH) -> StreamingQuery:
    """Heavy statistics of the whole table, computed anew after each batch, off the readers' path; they read the last result with latest(spark, path + "/result"). A batch is kept in as many files as there are cores, so that those who compute don't read one file of one row group in one task."""

    def each(batch: DataFrame, n: int) -> None:
        batch.repartition(batch.sparkSession.sparkContext.defaultParallelism).write.mode("overwrite").parquet(f"{path}/table/batch={n}")
        whole = _table(batch.sparkSession, f"{path}/table", n + 1, StructType(batch.schema.fields))
        compute(whole).write.mode("overwrite").parquet(f"{path}/result/batch={n}")
        deleted(batch.sparkSession, f"{path}/result/batch={n - 2}")

    return _start(stream, path, "append", each, every)


def due(last: Column, now: Column, hour: int = 3) -> Column:
    """Whether a daily job is due: its hour has come since it ran last, if only once for all days missed; also if it never ran."""
    shift = F.make_dt_interval(hours=F.lit(hour))
    return last.isNull() | (last < F.date_trunc("day", now - shift) + shift)


def scheduled(spark: SparkSession, path: str, now: datetime, run: Callable[[], None], hour: int = 3) -> bool:
    """Runs a daily job if it is due, and notes the time beside its sink; for a scheduler that calls it more often, or late."""
    at = f"{path}/_runs"
    try:
        last = spark.read.schema("at timestamp_ntz").parquet(at).agg(F.max("at")).first()[0]
    except AnalysisException:
        last = None
    times = spark.createDataFrame([(last, now)], "last timestamp_ntz, now timestamp_ntz")
    if not times.select(due(F.col("last"), F.col("now"), hour).alias("due")).first().due:
        return False
    run()
    spark.createDataFrame([(now,)], "at timestamp_ntz").write.mode("append").parquet(at)
    return True


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and values by type in windows of event time; in append or update mode rows later than the watermark are dropped, complete mode keeps all. An extension."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")).select(F.col("w.start").alias("start"), "event_type", "n", "v")
