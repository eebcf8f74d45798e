"""Questions about the search log (id, kind, a, b, status, hops, lang).

Pairs are folded by Unicode lower case. The spelling shown for a pair is that of its newest
row. Every order ends in the newest row's id, which is unique, so results have one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordweave.functions.text import norm, tier
from wordweave.operators.keyed import KeyedTable
from wordweave.operators.paths import hops as shortest
from wordweave.session import written

#: Pairs that are looked at again for the open and one-way lists; candidates of the English list; gap of a pair without a way back; threshold without a sample.
SCAN, CANDIDATES, NO_WAY_BACK, DEFAULT_FAR = 40, 300, 99, 6


def pairs(log: DataFrame) -> DataFrame:
    """(a, b, h, c, last) for each folded pair of log's rows: fewest hops, rows, newest id."""
    la, lb = F.lower("a").alias("la"), F.lower("b").alias("lb")
    return log.groupBy(la, lb).agg(F.max_by("a", "id").alias("a"), F.max_by("b", "id").alias("b"), F.min("hops").alias("h"), F.count(F.lit(1)).alias("c"), F.max("id").alias("last"))


def solved(log: DataFrame) -> DataFrame:
    return log.filter("kind = 'path' and status = 'ok'")


def far(log: DataFrame, threshold: int | Column, limit: int) -> DataFrame:
    return pairs(solved(log)).filter(F.col("h") >= threshold).orderBy(F.desc("h"), F.desc("last")).limit(limit).select("a", "b", "h", "c")


def far_beyond(log: DataFrame, threshold: DataFrame, limit: int) -> DataFrame:
    """far() from a measured threshold, one row (threshold)."""
    rows = pairs(solved(log)).crossJoin(F.broadcast(threshold)).filter("h >= threshold")
    return rows.orderBy(F.desc("h"), F.desc("last")).limit(limit).select("a", "b", "h", "c")


def clamped(n: int, least: int = 5, most: int = 300) -> int:
    """A page size as asked for, within bounds."""
    return max(least, min(n, most))


def far_english(log: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """The farthest CANDIDATES first, of these the ones with two English ends: fewer than `limit` may be left."""
    few = pairs(solved(log)).orderBy(F.desc("h"), F.desc("last")).limit(CANDIDATES).withColumns({"ka": norm(F.col("a")), "kb": norm(F.col("b"))})
    english = nodes.filter("lang = 'en'").select("key")
    both = few.join(english.withColumnRenamed("key", "ka"), "ka", "left_semi").join(english.withColumnRenamed("key", "kb"), "kb", "left_semi")
    return both.orderBy(F.desc("h"), F.desc("last")).limit(limit).select("a", "b", "h", "c")


def shared(log: DataFrame, limit: int) -> DataFrame:
    return pairs(log.filter("kind = 'share'")).orderBy(F.desc("c"), F.desc("last")).limit(limit).select("a", "b", "c", "h")


def top(log: DataFrame, limit: int) -> DataFrame:
    return pairs(solved(log)).orderBy(F.desc("c"), F.col("h").asc_nulls_first(), F.desc("last")).limit(limit).select("a", "b", "c", "h")


def recent(log: DataFrame, limit: int) -> DataFrame:
    return log.filter("kind = 'path'").orderBy(F.desc("id")).limit(limit).select("a", "b", "status", F.col("hops").alias("h"))


def live_words(log: DataFrame, limit: int = 18) -> DataFrame:
    words = log.filter("kind = 'word'").groupBy(F.lower("a").alias("la")).agg(F.max_by("a", "id").alias("a"), F.count(F.lit(1)).alias("c"), F.max("id").alias("last"))
    return words.orderBy(F.desc("last")).limit(limit).select("a", "c")


def folded(nodes: DataFrame) -> DataFrame:
    """(folded, key) of nodes (word, key): the key that a word has in any case, the least of several. What a word index holds."""
    return nodes.groupBy(F.lower("word").alias("folded")).agg(F.min("key").alias("key"))


def resolved(rows: DataFrame, words: KeyedTable, *columns: str) -> DataFrame:
    """rows with k<column>: the key of the node whose word it is in any case, null if none. Only the index's folders that the words fall in are read."""
    rows = written(rows, "asked")
    asked = rows.select(F.explode(F.array(*[F.lower(F.trim(c)) for c in columns])).alias("folded")).distinct()
    known = written(words.lookup(asked), "known")
    for c in columns:
        own = known.select(F.col("folded").alias(f"_{c}"), F.col("key").alias(f"k{c}"))
        rows = rows.withColumn(f"_{c}", F.lower(F.trim(c))).join(own, f"_{c}", "left").drop(f"_{c}")
    return rows


def open_pairs(log: DataFrame, words: KeyedTable) -> DataFrame:
    """(a, b, c, last, ka, kb): the SCAN most asked pairs without a path, with their nodes."""
    asked = pairs(log.filter("kind = 'path' and status <> 'ok'")).orderBy(F.desc("c"), F.desc("last")).limit(SCAN)
    return written(resolved(asked, words, "a", "b"), "open-pairs")


def recent_pairs(log: DataFrame, words: KeyedTable) -> DataFrame:
    """(a, b, last, ka, kb): of the SCAN newest solved pairs each unordered pair once, if both ends are nodes."""
    newest = pairs(solved(log)).orderBy(F.desc("last")).limit(SCAN)
    unordered = Window.partitionBy(F.least(F.lower("a"), F.lower("b")), F.greatest(F.lower("a"), F.lower("b"))).orderBy(F.desc("last"))
    once = newest.withColumn("n", F.row_number().over(unordered)).filter("n = 1")
    return written(resolved(once, words, "a", "b").filter("ka is not null and kb is not null"), "recent-pairs")


def requests(pairs_: DataFrame, kind: str, back: bool = False) -> DataFrame:
    """Pairs (last, ka, kb) as requests (qid, src, dst) of a kind, to be searched with others in one batch."""
    src, dst = ("kb", "ka") if back else ("ka", "kb")
    known = pairs_.filter("ka is not null and kb is not null")
    return known.select(F.concat(F.lit(f"{kind}:"), F.col("last").cast("string")).alias("qid"), F.col(src).alias("src"), F.col(dst).alias("dst"))


def answers(ways: DataFrame, kind: str, name: str) -> DataFrame:
    """(last, <name>) of the searched pairs (qid, hops) of a kind."""
    own = ways.filter(F.col("qid").startswith(f"{kind}:"))
    return own.select(F.substring("qid", len(kind) + 2, 20).cast("long").alias("last"), F.col("hops").alias(name))


def open_list(asked: DataFrame, ways: DataFrame, limit: int = SCAN) -> DataFrame:
    """open_pairs() less those that have a path by now (`open` among ways). Words that are no nodes stay open."""
    rest = asked.join(answers(ways, "open", "hops").filter("hops is not null"), "last", "left_anti")
    return rest.orderBy(F.desc("c"), F.desc("last")).limit(limit).select("a", "b", "c")


def one_way_list(recent_: DataFrame, ways: DataFrame, limit: int = SCAN) -> DataFrame:
    """recent_pairs() whose way back (`back` among ways) is 2 hops longer than the way there, or missing."""
    gap = F.when(F.col("back").isNull(), NO_WAY_BACK).otherwise(F.col("back") - F.col("fwd"))
    rows = recent_.join(answers(ways, "there", "fwd"), "last").join(answers(ways, "back", "back"), "last").filter("fwd is not null").withColumn("gap", gap).filter("gap >= 2")
    return rows.orderBy(F.desc("gap"), "fwd", F.desc("last")).limit(limit).select("a", "b", "fwd", "back", "gap")


def still_open(log: DataFrame, words: KeyedTable, edges: DataFrame, limit: int = SCAN) -> DataFrame:
    """The most asked pairs without a path, SCAN of them, less those that have one by now."""
    asked = open_pairs(log, words)
    return open_list(asked, shortest(edges, requests(asked, "open")), limit)


def one_way(log: DataFrame, words: KeyedTable, edges: DataFrame, limit: int = SCAN) -> DataFrame:
    """Of the SCAN newest solved pairs those whose way back is 2 hops longer or missing; ways there and back are one search."""
    newest = recent_pairs(log, words)
    return one_way_list(newest, shortest(edges, requests(newest, "there").union(requests(newest, "back", True))), limit)


def distribution(sample: DataFrame) -> DataFrame:
    """(hops, pairs, share) of solved pairs of a sample: share has at least so many hops."""
    counts = sample.filter("hops is not null").groupBy("hops").agg(F.count(F.lit(1)).alias("pairs"))
    upward = Window.orderBy(F.desc("hops")).rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("hops", "pairs", (F.sum("pairs").over(upward) / F.sum("pairs").over(Window.partitionBy())).alias("share"))


def far_threshold(dist: DataFrame, p: float = 0.10) -> DataFrame:
    """One row (threshold): the least hops whose share is p at most, else the most hops; DEFAULT_FAR without a sample."""
    return dist.agg(F.coalesce(F.min(F.when(F.col("share") <= p, F.col("hops"))), F.max("hops"), F.lit(DEFAULT_FAR)).alias("threshold"))


def with_rarity(rows: DataFrame, dist: DataFrame) -> DataFrame:
    """rows (hops, ..) with `rarity`, the share of sampled pairs at least as far, and `tier`; null without a sample."""
    # The distribution has one row for each distance; the share of those at least as far is the one of the next distance there is.
    d = dist.select(F.col("hops").alias("_h"), F.col("share").alias("_s"))
    every = d.agg(F.array_sort(F.collect_list(F.struct("_h", "_s"))).alias("_d"))
    joined = rows.crossJoin(F.broadcast(every))  # one row
    at = F.filter("_d", lambda x: x["_h"] >= F.col("hops"))
    rarity = F.when(F.col("hops").isNotNull() & (F.size("_d") > 0), F.coalesce(F.get(at, 0)["_s"], F.lit(0.0)))
    return joined.withColumn("rarity", rarity).withColumn("tier", tier(F.col("rarity"))).drop("_d")


def solve(asked_for: DataFrame, words: KeyedTable, responses: DataFrame, edges: DataFrame, records: DataFrame, dist: DataFrame, valid: Column) -> DataFrame:
    """asked_for (qid, a, b, ok_a, ok_b) answered: status badword, unseen, nolink or ok, in this order; hops, rarity, tier, prev and whether it is a record.

    responses: (word) that have one. ok_a, ok_b: whether a word may be asked for; `valid` says both are.
    """
    has = responses.select(F.lower("word").alias("w")).distinct().withColumn("has", F.lit(True))
    r = asked_for.join(has.select(F.col("w").alias("wa"), F.col("has").alias("has_a")), F.lower("a") == F.col("wa"), "left").drop("wa").join(has.select(F.col("w").alias("wb"), F.col("has").alias("has_b")), F.lower("b") == F.col("wb"), "left").drop("wb")
    r = resolved(r.fillna(False, ["has_a", "has_b"]), words, "a", "b")
    asked = r.filter("has_a and has_b and ka is not null and kb is not null").select("qid", F.col("ka").alias("src"), F.col("kb").alias("dst"))
    r = r.join(shortest(edges, asked).select("qid", "hops", F.col("status").alias("way")), "qid", "left")
    bad = (~F.col("ok_a") & ~F.col("has_a")) | (~F.col("ok_b") & ~F.col("has_b"))
    status = F.when(bad | ~valid, "badword").when(~(F.col("has_a") & F.col("has_b")), "unseen").when(F.col("way") == "ok", "ok").when(F.col("way") == "capped", "capped").otherwise("nolink")
    r = r.withColumn("status", status).withColumn("hops", F.when(F.col("status") == "ok", F.col("hops")))
    best = records.select("norm_a", "norm_b", F.col("hops").alias("prev"))
    r = r.withColumns({"norm_a": norm(F.col("a")), "norm_b": norm(F.col("b"))}).join(best, ["norm_a", "norm_b"], "left")
    record = F.when(F.col("status") == "ok", F.col("prev").isNull() | (F.col("hops") < F.col("prev")))
    return with_rarity(r, dist).select("qid", "a", "b", "status", "hops", F.when(F.col("status") == "ok", F.col("rarity")).alias("rarity"), F.when(F.col("status") == "ok", F.col("tier")).alias("tier"), F.when(F.col("status") == "ok", F.col("prev")).alias("prev"), record.alias("record"))


def claims(answers: DataFrame, names: DataFrame, records: DataFrame) -> DataFrame:
    """What becomes of claims to records: answers of solve() with names (qid, name), against records (norm_a, norm_b, hops, finder).

    (qid, a, b, norm_a, norm_b, accepted, hops, holder): a claim is solved again, whatever its
    sender says, and accepted if it has strictly fewer hops than the record or is the first; its
    name is cut to 24 characters, none is null. One that isn't shows the record and its holder,
    and one without a path nothing.
    """
    name = F.substring(F.trim("name"), 1, 24)
    held = records.select("norm_a", "norm_b", F.col("hops").alias("_hops"), F.col("finder").alias("_finder"))
    rows = answers.select("qid", "a", "b", "status", "hops").join(names.select("qid", F.when(name != "", name).alias("name")), "qid")
    rows = rows.withColumns({"a": F.trim("a"), "b": F.trim("b")}).filter("a <> '' and b <> ''").withColumns({"norm_a": norm(F.col("a")), "norm_b": norm(F.col("b"))}).join(held, ["norm_a", "norm_b"], "left")
    solved_ = F.col("status") == "ok"
    won = solved_ & (F.col("_hops").isNull() | (F.col("hops") < F.col("_hops")))
    return rows.select("qid", "a", "b", "norm_a", "norm_b", won.alias("accepted"), F.when(won, F.col("hops")).when(solved_, F.col("_hops")).alias("hops"), F.when(won, F.col("name")).when(solved_, F.col("_finder")).alias("holder"))


def share_events(posts: DataFrame) -> DataFrame:
    """posts (a, b, to, hops as text) as log rows: both words needed, destination cut to 20 characters, hops null unless a whole number."""
    a, b = F.trim(F.coalesce("a", F.lit(""))), F.trim(F.coalesce("b", F.lit("")))
    return posts.select(F.lit("share").alias("kind"), a.alias("a"), b.alias("b"), F.substring(F.coalesce("to", F.lit("")), 1, 20).alias("status"), F.col("hops").try_cast("int").alias("hops")).filter("a <> '' and b <> ''")
