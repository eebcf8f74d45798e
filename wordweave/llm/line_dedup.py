"""Line dedup by sorted hash ranges, with keep bitmaps as its result.

Each line of enough characters becomes a row of a 128-bit hash of its key, its document and
its position. Rows are dealt by ranges of the hash, which is uniform, so equal ranges need no
sampling, and within a range by shares of the documents, so a very common line is in many
tasks. Each is sorted by hash, document from the end, and position, and streamed once: where
the hash changes, its first occurrence in this document order begins; where the document
changes, it has one document more. The first occurrences of a hash's shares, combined in each
task before they are shuffled, give its number of documents and the document that keeps the
line. Those of the repeated hashes, joined with the rows, give the positions to drop. What
comes back for a document is a compressed bitmap (runs of dropped lines), no text;
keep_lines() applies it.

Results in special cases: null and empty text is one empty line, which is kept; blank and
short lines stay; a text of any length is judged whole; rows that agree in doc_id and text
are one document, and each of them gets its bitmap; a null doc_id is smaller than any other;
documents with one doc_id and different texts count as one where documents are counted, and
keep lines together; an empty table gives an empty result; other columns are ignored or kept as they are.
Two of n different keys share a hash with odds of n * n / 2**129 at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordweave.functions.arrays import bound
from wordweave.llm.shared import documents, keyed, written

MIN_CHARS, MIN_DOCS = 20, 3
#: Ranges of hashes, as a power of 2, and shares of documents in each.
RANGE_BITS, SHARES = 10, 4096
_SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(did, tkey, drop) of the documents that lose lines. drop: array of (start, len), runs of dropped lines, by position from 0."""
    lines = keyed(docs).select("did", "tkey", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = lines.select("did", "tkey", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    hashed = keys.select(F.xxhash64("key").alias("a"), F.xxhash64(F.lit("b"), "key").alias("b"), "did", "tkey", "pos")
    hashed = hashed.withColumns({"range": F.shiftrightunsigned("a", 64 - RANGE_BITS), "share": F.pmod(F.xxhash64("did"), F.lit(SHARES).cast("long"))})
    stream = Window.partitionBy("range", "share", "a", "b").orderBy(F.desc("did"), F.desc("tkey"), F.asc("pos"))
    before = F.lag("did").over(stream)
    streamed = hashed.repartition("range", "share").select("a", "b", "did", "tkey", "pos", (before.isNull() | (before != F.col("did"))).alias("opens"))
    sorted_rows = written(streamed, "lines")
    firsts = sorted_rows.filter("opens").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("did").alias("keeper"))
    repeated = written(firsts.filter(F.col("n") >= min_docs).select("a", "b", "keeper"), "repeated")
    dropped = sorted_rows.join(repeated, ["a", "b"]).filter("did <> keeper").groupBy("did", "tkey").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    first = F.filter("p", lambda x, i: (i == 0) | (F.get("p", i - 1) != x - 1))
    last = F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get("p", i + 1) != x + 1))
    runs = dropped.select("did", "tkey", first.alias("f"), last.alias("l"))
    return runs.select("did", "tkey", F.transform(F.arrays_zip("f", "l"), lambda r: F.struct(r["f"].alias("start"), (r["l"] - r["f"] + 1).alias("len"))).alias("drop"))


def keep_lines(text: Column, drop: Column) -> Column:
    """The text without the lines of a bitmap; null drops none."""
    end = lambda r: r["start"] + r["len"]
    from_ = lambda i: F.when(i == 0, 0).otherwise(end(F.get(drop, i - 1)))

    def kept(lines: Column) -> Column:
        between = F.transform(drop, lambda r, i: F.slice(lines, from_(i) + 1, r["start"] - from_(i)))
        rest = end(F.element_at(drop, -1))
        return F.array_join(F.concat(F.flatten(between), F.slice(lines, rest + 1, F.size(lines) - rest)), "\n")

    return F.when(drop.isNull(), text).otherwise(bound(lines_of(text), kept))  # a text is split once


def with_bitmaps(docs: DataFrame, **limits: int) -> DataFrame:
    """Each row of docs as the struct `row`, with `drop`. The text side is streamed, not sorted; the bitmaps are hashed."""
    bitmaps = written(keep_bitmaps(docs, **limits), "bitmaps").hint("shuffle_hash")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("did"), F.xxhash64(text).alias("tkey"))
    return rows.join(bitmaps, ["did", "tkey"], "left").select("row", "drop")


def dedup_lines(docs: DataFrame, **limits: int) -> DataFrame:
    """docs with the repeated lines gone from text, other columns as they are."""
    return with_bitmaps(docs, **limits).select(*[(keep_lines(F.col("row.text"), F.col("drop")) if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_bitmaps(documents(spark, sf_dir).select("doc_id", "text"))
    text = F.coalesce("row.text", F.lit(""))
    return rows.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size(lines_of(text)).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("drop", F.lit(0), lambda n, r: n + r["len"]), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(keep_lines(text, F.col("drop")), 256).alias("kept_sha256"),
    )


OP9_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, u.i AS i, u.line AS line,
         translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i, 'line': x})) AS u FROM docs)),
repeated AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT l.*, r.k IS NOT NULL AND r.keeper <> l.doc_id AS gone FROM lines l LEFT JOIN repeated r ON r.k = l.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
