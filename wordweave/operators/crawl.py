"""What to expand next: frontier, pools, seeds, and the ledger of external calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordweave.functions.text import cache_key, is_word, json_string, norm
from wordweave.operators.metrics import by_hash, in_degrees
from wordweave.session import written


def unexpanded(edges: DataFrame, nodes: DataFrame, responses: DataFrame, langs: Sequence[str] = ()) -> DataFrame:
    """(word, indeg, lang) of edge targets that have no response (key); languages only if any are named."""
    open_ = in_degrees(edges.join(responses.select(F.col("key").alias("dst")).distinct(), "dst", "left_anti"))
    out = open_.join(nodes.select(F.col("key").alias("word"), "lang"), "word")
    return out.filter(F.col("lang").isin(*langs)) if langs else out


def frontier(edges: DataFrame, nodes: DataFrame, responses: DataFrame, limit: int, langs: Sequence[str] = ()) -> DataFrame:
    """The `limit` of highest in-degree first, of these the ones that may be nodes."""
    top = unexpanded(edges, nodes, responses, langs).orderBy(F.desc("indeg"), "word").limit(limit)
    return top.filter(is_word(F.col("word")))


def pool(edges: DataFrame, nodes: DataFrame, responses: DataFrame, lang: str, n: int, seed: str = "42") -> DataFrame:
    """Half by in-degree, half by chance, each word once, in this order."""
    rows = unexpanded(edges, nodes, responses, [lang]).select("word", "indeg")
    top = rows.orderBy(F.desc("indeg"), "word").limit(n // 2).withColumn("part", F.lit(0))
    rest = by_hash(rows, "word", seed, n - n // 2).withColumn("part", F.lit(1))
    return merged([top.select("word", "part", F.col("indeg").alias("score")), rest.select("word", "part", F.col("indeg").alias("score"))])


def merged(parts: Sequence[DataFrame], seen: DataFrame | None = None) -> DataFrame:
    """parts (word, part, score), earlier parts first: one row for each key, of words that may be nodes and whose key isn't in seen (key)."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    keyed = every.withColumn("key", norm(F.col("word"))).filter(is_word(F.col("word")))
    once = keyed.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("part", F.desc("score"), "word"))).filter("n = 1").drop("n")
    return (once if seen is None else once.join(seen.select("key").distinct(), "key", "left_anti")).select("word", "part", "score")


def schedule(fixed: DataFrame, pooled: DataFrame, first: int = 120, limit: int = 1000, seed: str = "42") -> DataFrame:
    """(word): `first` fixed seeds in shuffled order, then the pool by in-degree, `limit` in all."""
    a = by_hash(fixed.select("word"), "word", seed, first).select("word", F.lit(0).alias("part"), F.lit(0).cast("long").alias("score"))
    b = pooled.select("word", F.lit(1).alias("part"), F.col("score").cast("long").alias("score"))
    return a.unionByName(b).orderBy("part", F.desc("score"), F.md5("word"), "word").limit(limit).select("word")


def schedules(edges: DataFrame, nodes: DataFrame, responses: DataFrame, fixed: DataFrame, n: int = 900, first: int = 120, limit: int = 1000, langs: Sequence[str] = (), seed: str = "42") -> DataFrame:
    """(lang, place, word): the schedules of all languages, or of those named, in one pass.

    For each: `first` of its fixed seeds (lang, word) in shuffled order, then its pool of n words
    that have no response, half by in-degree and half by chance, those that may be nodes in the
    order of in-degrees; no key twice, `limit` in all. Spark cuts ranks of up to 1,000 before it shuffles, so a language
    that holds most words isn't sorted as a whole.
    """
    by = Window.partitionBy("lang")
    chance = F.md5(F.concat(F.lit(seed), F.col("word")))
    best = lambda rows, order, k: rows.withColumn("i", F.row_number().over(by.orderBy(*order, "word"))).filter(F.col("i") <= k)
    open_ = written(unexpanded(edges, nodes, responses, langs).select("lang", "word", "indeg"), "open")
    given = fixed.filter(F.col("lang").isin(*langs)) if langs else fixed
    parts = best(given.select("lang", "word").distinct(), [chance], first).select("lang", "word", F.lit(0).alias("part"), F.lit(0).cast("long").alias("score"))
    for rows in (best(open_, [F.desc("indeg")], n // 2), best(open_, [chance], n - n // 2)):
        parts = parts.union(rows.select("lang", "word", F.lit(1), F.col("indeg").cast("long")))
    keyed = parts.withColumn("key", norm(F.col("word"))).filter((F.col("part") == 0) | is_word(F.col("word")))
    order = ["part", F.desc("score"), F.md5("word"), "word"]
    once = keyed.withColumn("i", F.row_number().over(Window.partitionBy("lang", "key").orderBy(*order))).filter("i = 1")
    return once.withColumn("place", F.row_number().over(by.orderBy(*order))).filter(F.col("place") <= limit).select("lang", "place", "word")


def ranked_seeds(mentions: DataFrame, limit: int = 400) -> DataFrame:
    """mentions (source, word, pos): words of most sources first, then by best place within a source, then by mentions."""
    per = mentions.groupBy("word").agg(F.count(F.lit(1)).alias("mentions"), F.size(F.collect_set("source")).alias("sources"), F.min("pos").alias("best"))
    return per.orderBy(F.desc("sources"), "best", F.desc("mentions"), "word").limit(limit)


def ledger(calls: DataFrame) -> DataFrame:
    """calls (kind, cache_key, output, id) with each (kind, cache_key) once, the earliest."""
    first = Window.partitionBy("kind", "cache_key").orderBy("id")
    return calls.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def through_cache(requests: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (kind, cache_key) that the ledger answers, with `output`, and those it misses."""
    known = ledger(calls).select("kind", "cache_key", "output")
    return requests.join(known, ["kind", "cache_key"]), requests.join(known, ["kind", "cache_key"], "left_anti")


def response_calls(responses: DataFrame, seed: int = 42) -> DataFrame:
    """(kind, cache_key, output, id) of stored responses (id, word, text, model) under the keys that their calls have now, to be inserted into a ledger whose keys were made otherwise."""
    key = cache_key(model=json_string(F.col("model")), seed=F.lit(str(seed)), word=json_string(F.col("word")))
    return responses.select(F.lit("response").alias("kind"), key.alias("cache_key"), F.col("text").alias("output"), "id")


def proposal_precision(proposals: DataFrame, edges: DataFrame) -> DataFrame:
    """proposals (target, word): of the words said to lead to a target, how many do. One row a target, and the whole as null."""
    hit = proposals.join(edges.select(F.col("src").alias("word"), F.col("dst").alias("target"), F.lit(1).alias("hit")).distinct(), ["word", "target"], "left")
    return hit.rollup("target").agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.count(F.lit(1)).alias("total")).withColumn("precision", F.col("hits") / F.col("total"))


def rounds(edges: DataFrame, seeds: DataFrame, width: int, most: int) -> DataFrame:
    """(word, round, known) of a crawl over what the ledger holds: seeds (word) first, then in each round the `width` words of highest in-degree among what was found and not asked for.

    edges (src, dst) are the answers of known words; a word without any is asked once and
    missed. It ends with an empty frontier or after `most` rounds.
    """
    heads = written(edges.select(F.col("src").alias("word")).distinct(), "heads")
    asked = written(seeds.select("word").distinct().withColumn("round", F.lit(1)), "asked")
    for turn in range(2, most + 1):
        own = edges.join(asked.select(F.col("word").alias("src")), "src", "left_semi")
        open_ = in_degrees(own.join(asked.select(F.col("word").alias("dst")), "dst", "left_anti"))
        next_ = written(open_.orderBy(F.desc("indeg"), "word").limit(width).filter(is_word(F.col("word"))).select("word", F.lit(turn).alias("round")), "asked")
        if next_.isEmpty():
            break
        asked = written(asked.union(next_), "asked")
    return asked.join(heads.withColumn("known", F.lit(True)), "word", "left").select("word", "round", F.coalesce("known", F.lit(False)).alias("known"))
