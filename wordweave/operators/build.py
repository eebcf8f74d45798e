"""From texts to the association graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordweave.functions.arrays import bound
from wordweave.functions.text import clean, is_junk_token, norm, script, token_key, tokens
from wordweave.operators.store import insert_edges, insert_or_ignore, with_ids
from wordweave.session import written


def neighbours(texts: DataFrame, words: Column | None = None) -> DataFrame:
    """(id, head, low, word, rank) of texts (id, head, text): each distinct token in any case, but the head, by first place. words: an array of each text's words, such as a tagger's nouns, in place of tokens.

    Tokens are cut, dropped and made distinct inside the row, so nothing is shuffled.
    """
    own = F.lower(clean(F.coalesce("head", F.lit(""))))
    seen = lambda words: F.array_sort(F.transform(words, lambda w, i: F.struct(F.lower(w).alias("low"), i.alias("pos"), w.alias("word"))))
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["low"] != x["low"]))
    kept = lambda s: F.filter(first(s), lambda x: ~is_junk_token(x["low"]) & (x["low"] != own))
    ranked = F.array_sort(F.transform(bound(bound(tokens(F.coalesce("text", F.lit(""))) if words is None else words, seen), kept), lambda x: F.struct(x["pos"], x["low"], x["word"])))
    return texts.select("id", "head", F.posexplode(ranked).alias("at", "x")).select("id", "head", "x.low", "x.word", (F.col("at") + 1).alias("rank"))


def document_texts(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) as texts: the head is the first token."""
    return docs.select(F.col("doc_id").alias("id"), F.lower(F.get(tokens(F.coalesce("text", F.lit(""))), 0)).alias("head"), "text").filter("head is not null")


def edges(texts: DataFrame, keep_loops: bool = False, by: Sequence[str] = (), words: Column | None = None) -> DataFrame:
    """(src, dst, rank), keys of nodes: the least rank of each pair. Surfaces with one key leave gaps in ranks; self-loops go unless wanted. by: columns of texts that tell graphs apart, such as config_id; words: as for neighbours()."""
    own = F.lower(clean(F.coalesce("head", F.lit(""))))
    low = F.array_distinct(F.transform(tokens(F.coalesce("text", F.lit(""))) if words is None else words, F.lower))
    kept = F.filter(low, lambda w: ~is_junk_token(w) & (w != own))
    key = token_key if words is None else norm
    pairs = texts.select(*by, norm(F.col("head")).alias("src"), F.posexplode(kept).alias("at", "low")).select(*by, "src", key(F.col("low")).alias("dst"), (F.col("at") + 1).alias("rank"))
    pairs = pairs.filter("src <> '' and dst <> ''")
    return (pairs if keep_loops else pairs.filter("src <> dst")).groupBy(*by, "src", "dst").agg(F.min("rank").alias("rank"))


def retokenised(responses: DataFrame, nodes: DataFrame, surfaces: DataFrame, edges_: DataFrame, config_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The next nodes (id, key, word, lang), surfaces (node_id, text) and edges (config_id, src_id, dst_id, rank) after all responses (id, head, text) are tokenised into a config.

    Keys get the id that they have or the next ones, surfaces and edges that are there stay.
    """
    fresh = nodes_of(responses)
    out = written(with_ids(nodes, fresh, ["key"], "key"), "nodes")
    ids = out.select("id", "key")
    seen = surfaces_of(responses).join(ids, "key").select(F.col("id").alias("node_id"), "text")
    pairs = edges(responses).join(ids.select(F.col("id").alias("src_id"), F.col("key").alias("src")), "src").join(ids.select(F.col("id").alias("dst_id"), F.col("key").alias("dst")), "dst")
    pairs = pairs.select(F.lit(config_id).cast("long").alias("config_id"), "src_id", "dst_id", "rank")
    return out, insert_or_ignore(surfaces, seen, ["node_id", "text"], "text"), insert_edges(edges_, pairs)


def nodes(texts: DataFrame) -> DataFrame:
    """(key, word, lang) of every token and head: the surface of the earliest text, then place, and its script."""
    own = texts.select("id", F.lit(-1).alias("at"), clean(F.col("head")).alias("word"))
    low = F.array_distinct(F.transform(tokens(F.coalesce("text", F.lit(""))), F.lower))
    words = texts.select("id", F.posexplode(F.filter(low, lambda w: ~is_junk_token(w))).alias("at", "word"))
    both = own.select(norm(F.col("word")).alias("key"), "id", "at", "word").union(words.select(token_key(F.col("word")).alias("key"), "id", "at", "word")).filter("key <> ''")
    first = both.groupBy("key").agg(F.min_by("word", F.struct("id", "at", "word")).alias("word"))
    return first.select("key", "word", script(F.col("word")).alias("lang"))


def surfaces(texts: DataFrame) -> DataFrame:
    """(key, text): every surface seen of a node."""
    return texts.select(F.explode(tokens(F.coalesce("text", F.lit("")))).alias("text")).select(norm(F.col("text")).alias("key"), "text").filter("key <> ''").distinct()


def mentions(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (src, dst) with `holds`: whether a text of src's head has a token with dst's key."""
    keys = texts.select(norm(F.col("head")).alias("s"), F.explode(F.array_distinct(F.transform(tokens(F.coalesce("text", F.lit(""))), norm))).alias("d")).distinct().withColumn("holds", F.lit(True))
    return pairs.join(keys, (norm(F.col("src")) == F.col("s")) & (norm(F.col("dst")) == F.col("d")), "left").select("src", "dst", F.coalesce("holds", F.lit(False)).alias("holds"))


nodes_of, surfaces_of = nodes, surfaces


def with_flags(edges_: DataFrame, nodes_: DataFrame) -> DataFrame:
    """edges with src_ok and dst_ok, the flags of their ends among nodes (key, ok): joined once, when edges are stored, so that no reader has to. An end that is no node drops its edge."""
    flag = lambda end: nodes_.select(F.col("key").alias(end), F.col("ok").alias(f"{end}_ok"))
    return edges_.join(flag("src"), "src").join(flag("dst"), "dst")


def of_config(edges_: DataFrame, config_id: int) -> DataFrame:
    """(src, dst, rank) of one config's edges; stored by config, only its folder is read."""
    return edges_.filter(F.col("config_id") == config_id).select("src", "dst", "rank")


def usable(edges_: DataFrame, config_id: int) -> DataFrame:
    """(src, dst, rank) of a config's edges (.., src_ok, dst_ok) between nodes that aren't rejected; unknown ones count as good."""
    good = ~F.col("src_ok").eqNullSafe(False) & ~F.col("dst_ok").eqNullSafe(False)
    return of_config(edges_.filter(good), config_id)
