"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets are water-filled: a source's share of all words follows its weight, up to a number of
epochs of its own words; what is cut off goes to the others by weight. A document's key is
u ** (1 / w), u uniform from a hash of doc_id and seed, w its quality weight. Within a source,
documents in descending key order are a weighted sample without replacement of any length, so
those before the word budget are the sample. Whole epochs take each document once more; only
the rest of the target is sampled.

The order within a source is summed up in two levels: the square root of a key, a place in
[0, 1), names its bucket, bucket sums give each bucket's words before it, and only inside a
bucket rows are sorted. No task sorts a source. Square roots are uniform for weight 0.5; no
bucket gets more than twice its share of documents of weight 1, or 4 times of weight 2. Keys
themselves would put a 32nd of weight 0.5 into the last of 1,024 buckets.

Results in special cases: null text has size 0; a document of size 0 takes 0; sources whose
words are 0 have target 0; null source is a source of its own, last in order; rows that repeat
are rows of their own with equal keys, ordered by size, their text's hash and their other
columns, and each is taken as often as its own place says; null doc_id is
hashed as the string 'null'; an unknown or null quality counts as 1; an empty table gives an
empty result; other columns are kept or ignored, whatever their names. A document longer than
the rest of its source's budget is taken if its middle lies within it, so a source misses its
target by half a document at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordweave.llm.shared import documents, n_words, written

WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, "mix-1"
#: Of a source's keys; each bucket is sorted by itself.
BUCKETS = 1024
_MORE = ("_other", "_rid")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes (source, source_size) with `target`. One row for each source passes through one task: sources are few.

    With sources in order of cap / weight, the first so many stop at their caps; the others
    share what is left at one level of words by weight.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * float(max_epochs))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = rows.select(
        "source",
        "source_size",
        "w",
        "cap",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("w_left"),
    ).withColumn("level", F.col("left") / F.col("w_left"))
    level = F.max("level").over(every)  # it rises while sources are cut off, and falls once none is
    return rows.select("source", "source_size", F.least("cap", level * F.col("w")).alias("target"))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 of seed and doc_id."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(2**52)


def takes(rows: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """rows (doc_id, source, size, weight, tkey) with source_size, target and `times`, how often the mix takes the document.

    Rows may have two more columns: `_other`, a hash that orders rows which agree in the rest,
    and `_rid`, which tells all rows apart; _rid is passed on.
    """
    more = [c for c in _MORE if c in rows.columns]
    key = F.pow(uniform(F.col("doc_id"), seed), 1.0 / F.col("weight"))
    rows = written(rows.select("doc_id", "source", "size", "tkey", *more, key.alias("key"), (F.lit(buckets - 1) - F.floor(F.sqrt(key) * buckets)).cast("int").alias("bucket")), "mix-keys")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    inside = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("words").over(inside), F.lit(0)).alias("start"))
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("epochs", epochs.cast("long")).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = written(starts.alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.source", "bucket", "start", "source_size", "target", "epochs", "budget"), "mix-plan")
    ordered = Window.partitionBy("source", "bucket").orderBy(F.col("key").desc(), F.col("doc_id").asc_nulls_first(), "size", "tkey", *more)
    summed = rows.withColumn("upto", F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    both = summed.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.bucket") == F.col("p.bucket")))
    middle = F.col("start") + F.col("upto") - F.col("size") / 2
    return both.select("doc_id", "r.source", "size", "tkey", *more[1:], "source_size", "target", (F.col("epochs") + (middle <= F.col("budget")).cast("long")).alias("times"))


def sized(docs: DataFrame, quality: DataFrame | None = None, more: Sequence[str] = ()) -> DataFrame:
    """docs as the rows of takes(), with `more` columns of theirs. quality: (doc_id, quality), good documents (1) weigh 2, bad ones (0) 0.5, others 1."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tkey"), *more)
    if quality is None:
        return rows.withColumn("weight", F.lit(1.0))
    q = quality.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    weight = F.when(F.col("quality") >= 1, 2.0).when(F.col("quality") <= 0, 0.5).otherwise(1.0)
    return rows.join(q, "doc_id", "left").select("doc_id", "source", "size", "tkey", *more, weight.alias("weight"))


def mixed(docs: DataFrame, quality: DataFrame | None = None, **params) -> DataFrame:
    """The rows of docs as often as the mix takes them, other columns as they are.

    Rows are written with a number each, by which their times find them again; which rows that
    agree in all columns are taken more often makes no difference.
    """
    cells = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = written(docs.select(cells.alias("row"), F.xxhash64(F.to_json(F.struct(*rest))).alias("_other"), F.monotonically_increasing_id().alias("_rid")), "mix-rows")
    weighed = sized(rows.select("row.doc_id", "row.source", "row.text", *_MORE), quality, _MORE)
    times = written(takes(weighed, **params).filter("times > 0").select("_rid", "times"), "mix-times").hint("shuffle_hash")
    both = rows.join(times, "_rid")
    return both.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("epoch")).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = takes(sized(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return rows.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.round("target", 6).alias("target"), (F.col("times") * F.col("size")).alias("taken"))


OP6_SQL = r"""
WITH RECURSIVE q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN quality >= 1 THEN 2.0 WHEN quality <= 0 THEN 0.5 ELSE 1.0 END AS w,
         ((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents LEFT JOIN q USING (doc_id)),
s AS (
  SELECT source, sum(size)::DOUBLE AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source),
c AS (SELECT *, 3 * source_size AS cap FROM s),
o AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lev
  FROM c WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(lev) AS lev FROM o),
t AS (SELECT source, source_size, least(cap, l.lev * w) AS target, CASE WHEN source_size > 0 THEN floor(least(cap, l.lev * w) / source_size) ELSE 0 END AS epochs FROM o, l),
k AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.epochs,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY pow(u, 1.0 / d.w) DESC, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) - d.size / 2 AS middle
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, round(target, 6) AS target,
       ((epochs + (middle <= target - epochs * source_size)::INT) * size)::BIGINT AS taken
FROM k
"""
