"""The engine's tables as derived from the driver's: texts, graph, search log."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordweave.functions.arrays import bound, starts
from wordweave.operators import build, search_log
from wordweave.operators.keyed import KeyedTable
from wordweave.session import shared_dir, stored, stored_path
from wordweave.sources.readers import table


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.document_texts(table(spark, sf_dir, "documents"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored edges: they are built from the texts once, and read by every query about the graph."""
    return stored(spark, "edges", [f"{sf_dir}/documents.parquet"], lambda: build.edges(texts(spark, sf_dir)))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored nodes."""
    return stored(spark, "nodes", [f"{sf_dir}/documents.parquet"], lambda: build.nodes(texts(spark, sf_dir)))


def flagged(nodes: DataFrame) -> DataFrame:
    """Nodes with `ok`: false for a sixteenth of them by a hash of their key, unknown for another one."""
    h = F.left(F.md5("key"), F.lit(1))
    return nodes.withColumn("ok", F.when(h == "0", False).when(h != "1", True))


WORDS = "folded string, key string"


def words(spark: SparkSession, sf_dir: str) -> KeyedTable:
    """The stored index from a word in any case to its node's key, in folders by the folded word."""

    def build_() -> DataFrame:
        layout = KeyedTable(spark, f"{shared_dir(spark)}/stored/layout", WORDS, ["folded"])
        return layout.dealt(search_log.folded(nodes(spark, sf_dir))).repartition("bucket").sortWithinPartitions("bucket", "folded")

    return KeyedTable(spark, stored_path(spark, "words", [f"{sf_dir}/documents.parquet"], build_, by=["bucket"]), WORDS, ["folded"])


def config_id(lang: Column) -> Column:
    """Each language's texts are a config of their own."""
    return F.when(lang == "en", 0).when(lang == "fr", 1).when(lang == "de", 2).otherwise(9)


def config_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored edges (config_id, src, dst, rank, src_ok, dst_ok) of all configs, in folders by config; the flags of both ends were joined when they were written."""

    def build_() -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        own = build.document_texts(docs).join(docs.select(F.col("doc_id").alias("id"), config_id(F.col("lang")).alias("config_id")), "id")
        return build.with_flags(build.edges(own, by=["config_id"]), flagged(nodes(spark, sf_dir))).repartition("config_id", F.pmod(F.xxhash64("src"), F.lit(8)))

    return stored(spark, "config-edges", [f"{sf_dir}/documents.parquet"], build_, by=["config_id"])


def in_files(df: DataFrame, order: str, n: int) -> str:
    """df as n Parquet files at a path of its own, by ranges of a column, one written after the other: a stream of several batches."""
    path = f"{shared_dir(df.sparkSession)}/sources/{uuid.uuid4().hex}"
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    part = F.least(F.floor((F.col(order) - lo) * n / (hi - lo + 1)), F.lit(n - 1)) if hi is not None else F.lit(0)
    for i in range(n):
        df.filter(part == i).coalesce(1).write.parquet(f"{path}/part-{i:03d}.parquet")
    return path


def capital_tags(text: Column) -> Column:
    """A plain rule in a tagger's place, as nouns.TAGS: words with a capital are nouns, and modify the next word if that has one too."""

    def tag(words: Column, at: Column, big: Column) -> Column:
        def of(x: Column, i: Column) -> Column:
            before = F.get(big, i) & F.coalesce(F.get(big, i + 1), F.lit(False))
            name = F.when(F.get(big, i), "PROPN").otherwise("X")
            kind, head = F.when(before, "compound").otherwise("dep"), F.when(before, i + 1).otherwise(i)
            return F.struct(F.get(at, i).alias("start"), F.length(x).alias("len"), x.alias("text"), x.alias("lemma"), F.lit("").alias("tag"), name.alias("pos"), kind.alias("dep"), head.alias("head"), F.lit(False).alias("stop"), F.lit(False).alias("num"))

        return F.transform(words, of)

    every = lambda w: bound(starts(F.transform(w, lambda x: F.length(x) + 1)), lambda a: bound(F.transform(w, lambda x: x.rlike("^[A-Z]")), lambda b: tag(w, a, b)))
    return bound(F.split(text, " ", -1), every)


def from_events(events: DataFrame) -> DataFrame:
    """events as a search log; a stream of them gives a stream."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_type") == "signup", "word").when(F.col("event_type") == "purchase", "share").otherwise("path")
    status = F.when(F.col("event_type") == "signup", None).when(F.col("event_type") == "purchase", "link").when(F.col("event_type") == "error", "nolink").otherwise("ok")
    a = F.concat(F.lit("w"), (F.col("user_id") % 37).cast("string"))
    rows = events.select(F.col("event_id").alias("id"), kind.alias("kind"), F.when(F.col("event_id") % 3 == 0, F.upper(a)).otherwise(a).alias("a"), F.when(kind != "word", F.concat(F.lit("w"), (k % 41).cast("string"))).alias("b"), status.alias("status"), k.alias("k"), "value", F.col("ts").alias("created_at"))
    hops = F.when(F.col("kind") == "share", (F.col("k") % 7).cast("int")).when(F.col("status") == "ok", (F.floor("value") % 9 + 1).cast("int"))
    return rows.select("id", "kind", "a", "b", "status", hops.alias("hops"), "created_at")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


def graph_log(spark: SparkSession, sf_dir: str, edges: DataFrame, words: int = 41) -> DataFrame:
    """The search log with nodes of the graph for w0 to w40: the heads of least hash."""
    heads = edges.select("src").distinct().orderBy(F.md5("src"), "src").limit(words)
    names = heads.select(F.col("src").alias("word"), F.concat(F.lit("w"), (F.row_number().over(Window.orderBy(F.md5("src"), "src")) - 1).cast("string")).alias("w"))
    rows = log(spark, sf_dir)
    for c in ("a", "b"):
        own = names.select(F.col("w").alias(f"w_{c}"), F.col("word").alias(f"n_{c}"))
        rows = rows.join(F.broadcast(own), F.lower(c) == F.col(f"w_{c}"), "left")  # 41 rows
        rows = rows.withColumn(c, F.coalesce(F.when(F.col(c) == F.upper(c), F.upper(f"n_{c}")).otherwise(F.col(f"n_{c}")), F.col(c)))
    return rows.select("id", "kind", "a", "b", "status", "hops", "created_at")
