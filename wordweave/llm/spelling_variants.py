"""Spelling variants by a positional q-gram inverted index with a count filter.

Two words are near if one inserted, deleted or replaced letter makes one the other. Words are
letters a-z and U+00C0 to U+00FF, one byte each in ISO 8859-1. A posting says that a word of
some length has a gram of Q letters at some place; a list holds the postings of one gram,
length and place. One edit touches at most one of two grams that don't overlap, so of a word's
lists only those of two such grams have to be read, the two rarest ones: a near word of the
same length has one of the two at its place, a near word that is a letter longer has it there
or one place on. What those lists give for a word is merged by sorting, and a pair is kept if
the words share as many grams, at these places, as one edit must leave: all but Q of them, and
all but Q - 1 if a letter is inserted. What is kept is then compared letter by letter.

Lists and the words that read them are dealt by their key, a hash of gram, length and place;
of a key with more than BLOCK words on either side, blocks of both sides meet in tasks of
their own. Gram counts are what is broadcast: at most LETTERS**Q numbers. Of words longer than
LONG the first and the last gram are read, so that their lists don't grow with their square.

A word's form is its near word that occurs most, if that is `ratio` times as often. Forms
occur more often than the words they are of, so following them ends, after no more steps than
the logarithm of the counts; roots are found by doubling those steps.

Results in special cases: a null or empty text has no words; a null doc_id deletes no letter;
of forms that occur equally often the least in code-point order is taken; rows that repeat
count each; words of any length are compared whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordweave.llm.shared import documents, written
from wordweave.llm.wordhash import mix, text_buffers
from wordweave.session import released, ship

#: Letters of a word at least, its occurrences at least, times that a form occurs as often.
MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
#: Of the crc32 of doc_id and run, the divisor that marks runs which lose a letter.
DROP_EACH = 199
#: Letters of a gram; of the alphabet; length beyond which a word has only its ends in the index; words of a block.
Q, LETTERS, LONG, BLOCK = 3, 90, 64, 4096
#: Cells of a comparison of grams at once.
CELLS = 1 << 22
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CODE = np.zeros(256, np.int32)
_CODE[97:123] = np.arange(26)
_CODE[0xC0:] = np.arange(26, 90)


def lowered(run: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, _UPPER, _LOWER))


def occurrences(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """(word) for each run of `least` letters or more of docs (doc_id, text), some of them short of a letter. Shorter runs can't become words."""
    pattern = F.lit(r"[A-Za-zÀ-ÿ]{%d,}" % least)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col("text"), pattern, F.lit(0))).alias("run")).select("doc_id", lowered(F.col("run")).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run"))))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return runs.select(F.when(F.col("h") % DROP_EACH == 0, short).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least)


def counted(docs: DataFrame, least: int = MIN_CHARS, count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that occur `count` times or more."""
    return occurrences(docs, least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= count)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, letters) of a column of words in ISO 8859-1, for each length: a row of letters for each word."""
    raw, offsets = text_buffers(column)
    size = np.diff(offsets)
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        step = max(1, CELLS // max(1, int(length)))
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            yield part, raw[offsets[part][:, None] + np.arange(length)]


def grams(letters: np.ndarray) -> np.ndarray:
    """A row's grams as numbers below LETTERS**Q."""
    code = _CODE[letters]
    out = code[:, : code.shape[1] - Q + 1]
    for k in range(1, Q):
        out = out * LETTERS + code[:, k : code.shape[1] - Q + 1 + k]
    return out


def _key(gram: np.ndarray, length: int, at: np.ndarray) -> np.ndarray:
    """A list's key; keys that collide cost comparisons, no results."""
    with np.errstate(over="ignore"):
        where = np.uint64(length) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix(gram.astype(np.uint64) + where).view(np.int64)


def gram_counts(words: DataFrame) -> np.ndarray:
    """How many words (latin) have each gram, at LETTERS**Q places."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**Q, np.int64)
        for batch in batches:
            for _, letters in _by_length(batch.column(0)):
                total += np.bincount(grams(letters).ravel(), minlength=LETTERS**Q)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["gram", "n"])

    rows = words.select("latin").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(LETTERS**Q, np.int64)
    out[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    return out


def _probed(g: np.ndarray, length: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two grams of each word that are rarest together and don't overlap."""
    n = len(g)
    if length > LONG:
        return np.zeros(n, np.int64), np.full(n, length - Q, np.int64)
    cost = counts[g]
    last = g.shape[1] - 1
    best = np.empty_like(cost)  # the place of the rarest gram from a place on
    best[:, last] = last
    for j in range(last - 1, -1, -1):
        after = best[:, j + 1]
        best[:, j] = np.where(np.take_along_axis(cost, after[:, None], 1)[:, 0] < cost[:, j], after, j)
    second = best[:, Q:]
    both = cost[:, : second.shape[1]] + np.take_along_axis(cost, second, 1)
    first = both.argmin(1)
    return first, np.take_along_axis(second, first[:, None], 1)[:, 0]


ENTRY = "key long, probe boolean, latin binary, n long"


def entries(words: DataFrame, counts) -> DataFrame:
    """ENTRY rows of words (latin, n): a posting in each list that a word is in, a probe for each list that it has to read. counts: a broadcast of gram_counts()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, letters in _by_length(batch.column(0)):
                length = letters.shape[1]
                g, own = grams(letters), np.arange(len(rows))
                places = range(g.shape[1]) if length <= LONG + 1 else sorted({0, 1, length - Q - 1, length - Q})
                out = [(_key(g[:, p], length, np.full(len(rows), p)), own, False) for p in places]
                for at in _probed(g, length, counts.value):
                    gram = g[own, at]
                    out += [(_key(gram, to, place), own, True) for to, place in ((length, at), (length + 1, at), (length + 1, at + 1))]
                index = pa.array(rows[np.concatenate([r for _, r, _ in out])])
                probe = np.concatenate([np.full(len(r), p) for _, r, p in out])
                full = pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _, _ in out])), pa.array(probe), batch.column(0).take(index), batch.column(1).take(index)], names=["key", "probe", "latin", "n"])
                for lo in range(0, full.num_rows, 1 << 16):
                    yield full.slice(lo, 1 << 16)

    return words.select("latin", "n").mapInArrow(run, ENTRY)


def dealt(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """ENTRY rows with `deal`, the block of a key that they belong to: blocks of a key's postings meet blocks of its probes, each pair once."""
    load = rows.groupBy("key").agg(F.count_if(~F.col("probe")).alias("m"), F.count_if("probe").alias("p"))
    split = lambda c: F.ceil(F.col(c) / block).cast("long")
    useful = load.filter((F.col("m") > 0) & (F.col("p") > 0))  # lists that are read
    hot = written(useful.select("key", split("m").alias("m"), split("p").alias("p")), "lists")
    own = F.pmod(F.xxhash64("latin"), F.when(F.col("probe"), F.col("p")).otherwise(F.col("m")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("probe"), F.col("m")).otherwise(F.col("p")) - 1))
    met = rows.join(hot, "key").withColumn("own", own).withColumn("other", other)
    deal = F.when(F.col("probe"), F.col("other") * F.col("p") + F.col("own")).otherwise(F.col("own") * F.col("p") + F.col("other"))
    return met.select("key", deal.alias("deal"), "probe", "latin", "n")


def _near(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of two sets of words, equally long or the second a letter longer, that are near: by the count of shared grams, then by letters."""
    a, b = grams(short), grams(long)
    longer = long.shape[1] > short.shape[1]
    least = max(1, a.shape[1] - (Q - 1 if longer else Q))
    found = []
    step = max(1, CELLS // max(1, a.shape[1]) // max(1, len(b)))
    for lo in range(0, len(a), step):
        part = a[lo : lo + step, None, :]
        same = (part == b[None, :, : a.shape[1]]) | (part == b[None, :, 1:]) if longer else part == b[None]
        i, j = np.nonzero(np.count_nonzero(same, axis=2) >= least)
        found.append((i + lo, j))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = []
    for lo in range(0, len(i), cut := max(1, CELLS // long.shape[1])):
        x, y = short[i[lo : lo + cut]], long[j[lo : lo + cut]]
        if longer:
            before = np.logical_and.accumulate(x == y[:, :-1], axis=1).sum(1)
            after = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(1)
            keep.append(before + after >= x.shape[1])
        else:
            keep.append((x != y).sum(1) == 1)
    ok = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[ok], j[ok]


PAIR = "a binary, b binary, na long, nb long"


class _Group:
    """Rows of one block of a key, gathered over batches, to be compared when the next one begins."""

    def __init__(self) -> None:
        self.words: dict[bool, list[bytes]] = {False: [], True: []}
        self.counts: dict[bool, list[int]] = {False: [], True: []}

    def pairs(self) -> Iterator[tuple[list[bytes], list[bytes], list[int], list[int]]]:
        """Near pairs of probes and postings; of equally long words the lesser one probes."""
        if not (self.words[False] and self.words[True]):
            return
        sides = {}
        for side in (False, True):
            lengths: dict[int, list[int]] = {}
            for i, w in enumerate(self.words[side]):
                lengths.setdefault(len(w), []).append(i)
            sides[side] = {n: (rows, np.frombuffer(b"".join(self.words[side][i] for i in rows), np.uint8).reshape(len(rows), n)) for n, rows in lengths.items()}
        for n, (posted, long) in sides[False].items():
            for m in (n, n - 1):
                if m in sides[True]:
                    probes, short = sides[True][m]
                    i, j = _near(short, long)
                    rows = [(probes[x], posted[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
                    rows = [(x, y) for x, y in rows if m < n or self.words[True][x] < self.words[False][y]]
                    if rows:
                        yield [self.words[True][x] for x, _ in rows], [self.words[False][y] for _, y in rows], [self.counts[True][x] for x, _ in rows], [self.counts[False][y] for _, y in rows]


def pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, na, nb) of near words of `words` (word, n), each pair once; b is the longer one, or the greater."""
    spark = ship(words.sparkSession)
    latin = words.select(F.encode("word", "ISO-8859-1").alias("latin"), "n")
    counts = spark.sparkContext.broadcast(gram_counts(latin))
    rows = written(entries(latin, counts), "entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group = None, _Group()

        def found() -> Iterator[pa.RecordBatch]:
            for a, b, na, nb in group.pairs():
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(na, pa.int64()), pa.array(nb, pa.int64())], names=["a", "b", "na", "nb"])

        for batch in batches:
            key, deal = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            probe = batch.column(2).to_numpy(zero_copy_only=False)
            word, n = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (deal[1:] != deal[:-1]) | (probe[1:] != probe[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if hi > lo:
                    if (at := (key[lo], deal[lo])) != last:
                        yield from found()
                        last, group = at, _Group()
                    side = bool(probe[lo])
                    group.words[side] += word[lo:hi]
                    group.counts[side] += n[lo:hi]
        yield from found()

    met = dealt(rows, block).repartition("key", "deal").sortWithinPartitions("key", "deal", "probe")
    near = written(met.mapInArrow(run, PAIR).distinct(), "near")
    released(rows)
    text = lambda c: F.decode(F.col(c), "ISO-8859-1").alias(c)
    return near.select(text("a"), text("b"), "na", "nb")


def variants(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """words (word, n) with `form`, `root`, `n_near` and `form_n`."""
    near = pairs(words, block)
    both = near.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")).union(near.select("b", "a", "na"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), "near")).alias("best"))
    rows = words.join(best, "word", "left")
    m = -F.col("best.minus")
    formed = m >= ratio * F.col("n")
    rows = written(rows.select("word", F.when(formed, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, m).alias("form_n")), "forms")
    return rows.join(roots(rows), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: where forms (word, form) lead in the end."""
    to = forms.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = to.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = written(step, "roots")
        to = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return to


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its form, its root and how many words are near."""
    words = written(counted(documents(spark, sf_dir).select("doc_id", "text")), "words")
    return variants(words)


OP13_SQL = r"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(0, 256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(doc_id || ':' || run), '..'), lambda x: (instr('0123456789ABCDEF', x[1]) - 1) * 16 + instr('0123456789ABCDEF', x[2]) - 1)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM runs, crc),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gone AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS m FROM gone a JOIN gone b ON a.d = b.d AND a.i = b.i AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM gone a JOIN words w ON w.word = a.d
  UNION SELECT w.word, a.word, a.n FROM gone a JOIN words w ON w.word = a.d),
best AS (SELECT word, count(*) AS n_near, min({'minus': -m, 'near': near}) AS b FROM near GROUP BY word),
formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.minus >= 5 * n THEN b.near END AS form, CASE WHEN -b.minus >= 5 * n THEN -b.minus END AS form_n FROM words LEFT JOIN best USING (word)),
way(word, top) AS (SELECT word, word FROM formed UNION ALL SELECT w.word, f.form FROM way w JOIN formed f ON f.word = w.top WHERE f.form IS NOT NULL)
SELECT formed.word, formed.form, way.top AS root, formed.n, formed.n_near, formed.form_n FROM formed JOIN way USING (word) JOIN formed e ON e.word = way.top WHERE e.form IS NULL
"""
