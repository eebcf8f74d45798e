"""Sources and sinks: tables, word lists, TSV exchange files, JSON caches, feeds and page views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordweave.functions.text import clean, titles, wiki_title


#: Bytes of a table that are worth dealing out, and of a core's share that are still cheap to.
DEAL_FROM, DEAL_TO = 1 << 20, 64 << 20


def dealt(df: DataFrame) -> DataFrame:
    """A small table of fewer files than cores over all cores: a Parquet file of one row group is read by one task only. Others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if DEAL_FROM <= size <= cores * DEAL_TO and len(df.inputFiles()) < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def word_lines(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a text file with one word a line: trimmed, blank lines left out."""
    return spark.read.text(path).select(clean(F.col("value")).alias("word")).filter("word <> ''")


def write_word_lines(words: DataFrame, path: str) -> None:
    words.select("word").write.mode("overwrite").text(path)


def tsv_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a TSV file, plain or gzip, cut at the first tab; lines without one are left out."""
    at = F.instr("value", "\t")
    return spark.read.text(path).filter(at > 0).select(F.substring("value", F.lit(1), at - 1).alias("key"), F.substring("value", at + 1, F.length("value")).alias("value"))


def write_tsv(pairs: DataFrame, path: str) -> None:
    """(key, value) as gzip TSV, without quotes."""
    pairs.select(F.concat_ws("\t", "key", F.col("value").cast("string")).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def json_cache(spark: SparkSession, path: str) -> DataFrame:
    """(kind, key, value) of a directory of JSON files {"key", "value"}; the kind is the folder's name, key and value stay JSON."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_path").alias("file"))
    kind = F.element_at(F.split("file", "/"), -2)
    return raw.select(kind.alias("kind"), F.get_json_object("value", "$.key").alias("key"), F.get_json_object("value", "$.value").alias("value"))


def feed_titles(feeds: DataFrame) -> DataFrame:
    """(feed, pos, title) of feeds (feed, body): titles in order without the first, which is the feed's own; a null body has none."""
    return feeds.select("feed", F.posexplode(titles(F.coalesce("body", F.lit("")))).alias("pos", "title")).filter("pos > 0")


PAGE_VIEWS = "items array<struct<articles:array<struct<article:string,views:long,rank:long>>>>"


def page_view_titles(bodies: DataFrame) -> DataFrame:
    """(id, pos, title) of page-view documents (id, body): the first item's articles in order, as clean titles; broken JSON has none."""
    articles = F.get(F.from_json("body", PAGE_VIEWS)["items"], 0)["articles"]
    return bodies.select("id", F.posexplode(articles).alias("pos", "a")).select("id", "pos", wiki_title(F.col("a.article")).alias("title")).filter("title is not null")
