"""Known phrases in texts: longest match at token starts, then a greedy choice without overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordweave.functions.arrays import blocks, bound, chunks, piece, starts
from wordweave.functions.text import TOKEN, is_junk_token
from wordweave.session import written

#: Characters of the shortest phrase that counts, and of the longest one looked for.
LEAST, MOST = 4, 60
#: Of the blocks that token starts are cut from.
CUT = 1024
#: Characters after its first token that a phrase is looked up by; phrases whose index is sent to all tasks (some 100 bytes each).
BEYOND, BROADCAST = 4, 100_000


def vocabulary(nodes: DataFrame) -> DataFrame:
    """(phrase) of nodes (word) of LEAST characters or more with a space inside, lower-cased."""
    return nodes.filter((F.length("word") >= LEAST) & (F.instr("word", " ") > 0)).select(F.lower("word").alias("phrase")).distinct()


def spans(text: Column) -> Column:
    """array<struct<start, end, word>> of a text's tokens that are no junk, in characters."""
    words = F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))

    def placed(pairs: Column) -> Column:
        at = starts(F.transform(pairs, lambda x: F.length(x["gap"]) + F.length(x["word"])))
        return F.zip_with(pairs, at, lambda x, i: F.struct((i + F.length(x["gap"])).alias("start"), (i + F.length(x["gap"]) + F.length(x["word"])).alias("end"), x["word"].alias("word")))

    cut = lambda w: F.arrays_zip(F.slice(F.split(text, TOKEN, -1), F.lit(1), F.size(w)).alias("gap"), w.alias("word"))
    return F.filter(bound(bound(words, cut), placed), lambda s: ~is_junk_token(F.lower(s["word"])))


def _greedy(ordered: Column) -> Column:
    """Of spans by start, then the longer first, those that begin where the one chosen before has ended. Chunks are chosen from by themselves and put together."""
    none = F.array().cast("array<struct<start:int,end:int,word:string>>")
    step = lambda a, s: F.when(s["start"] >= a["last"], F.struct(s["end"].alias("last"), F.array_append(a["out"], s).alias("out"))).otherwise(a)
    chunk = lambda last, c: F.aggregate(c, F.struct(last.alias("last"), none.alias("out")), step)
    more = lambda a, c: bound(chunk(a["last"], c), lambda x: F.struct(x["last"].alias("last"), F.array_append(a["outs"], x["out"]).alias("outs")))
    zero = F.struct(F.lit(-1).alias("last"), F.array().cast("array<array<struct<start:int,end:int,word:string>>>").alias("outs"))
    return F.aggregate(bound(ordered, chunks), zero, more, lambda a: F.flatten(a["outs"]))


def index(phrases: DataFrame) -> DataFrame:
    """(key, beyond, phrase) of phrases (phrase): an inverted index by the first token and `beyond` characters after it, BEYOND of them if there are so many. A phrase that doesn't begin with a token is at no token's start."""
    first = F.length(F.regexp_extract("phrase", f"^(?:{TOKEN})", 0))
    beyond = F.least(F.length("phrase") - first, F.lit(BEYOND))
    known = phrases.filter(F.length("phrase").between(LEAST, MOST) & (first > 0))
    return known.select(F.xxhash64(F.left("phrase", first + beyond)).alias("key"), beyond.alias("beyond"), "phrase").distinct()


def with_known(texts: DataFrame, phrases: DataFrame, most: int = BROADCAST) -> DataFrame:
    """(id, spans) of texts (id, text): tokens, and at each token's start the longest known phrase; of what overlaps the earlier, then the longer stays.

    A token's start is looked up by a hash of the token and a few characters after it, which a
    phrase has to have there too. Of `most` phrases or fewer the index goes to the texts;
    of more, the hashes go to the index. Only starts with a phrase come back to their text,
    where the phrases are compared whole. Texts are shuffled once, without their spans.
    """
    known = written(index(phrases), "phrase-index")
    lengths = [r.beyond for r in known.select("beyond").distinct().collect()]  # BEYOND + 1 numbers at most
    small = known.limit(most + 1).count() <= most
    rows = texts.select("id", F.coalesce("text", F.lit("")).alias("text"))

    def keys(parts: Column) -> Column:
        size = lambda s, n: s["end"] - s["start"] + n
        at = lambda n: F.transform("s", lambda s: F.struct(s["start"].alias("start"), F.xxhash64(F.lower(piece(parts, s["start"], size(s, n), CUT))).alias("key")))
        return F.concat(*[at(n) for n in sorted(lengths)]) if lengths else F.array().cast("array<struct<start:int,key:bigint>>")

    starts_ = rows.withColumn("s", spans(F.col("text"))).select("id", F.explode(bound(blocks(F.col("text"), CUT), keys)).alias("k")).select("id", "k.*")
    listed = known.select("key", "phrase")
    met = starts_.join(F.broadcast(listed) if small else listed, "key").groupBy("id").agg(F.collect_set(F.struct("start", "phrase")).alias("met"))
    said = lambda p: F.transform("met", lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["phrase"])).alias("end"), piece(p, m["start"], F.length(m["phrase"]), CUT).alias("word"), m["phrase"].alias("phrase")))
    hits = F.filter(bound(blocks(F.col("text"), CUT), said), lambda h: F.lower(h["word"]) == h["phrase"])
    none = F.array().cast("array<struct<start:int,end:int,word:string>>")
    plain = F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["word"].alias("word")))
    every = rows.join(met, "id", "left").select("id", F.concat(spans(F.col("text")), F.coalesce(plain, none)).alias("every"))
    ordered = F.transform(F.array_sort(F.transform("every", lambda s: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("minus"), s["end"].alias("end"), s["word"].alias("word")))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["word"].alias("word")))
    return every.select("id", _greedy(ordered).alias("spans"))
