"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbouring words and pairs with one word
between them, as 32-bit hashes. A word is a run of ASCII letters, digits and bytes beyond
ASCII, A-Z in lower case. The model is a weight for some features and a bias; a score is the
logistic function of their sum.

What teaches is a sample of at most `sample` labelled documents: of either label up to half,
or what the other one leaves, the first by a hash of doc_id, so it is the same at each run.
As the sample has another share of toxic documents than the labels, the bias is corrected by
the logarithm of the ratio. Features in MIN_DOCS documents of the sample are learned, the
VOCABULARY commonest of them. The sample is dealt to SHARDS; in each round every shard runs
FTRL-proximal over its documents from the common state, with a rate for each coordinate, and
the mean of what they add is the next state. Weights whose sum of gradients stays below L1 are
0; the others, some hundreds, are what is broadcast for scoring.

Results in special cases: a null or empty text has no features and scores the bias alone; if
nothing can be learned (no labels, or one label only) the score is the share of toxic labels,
0 without labels; a document with several labels is toxic if one says so, null labels are
left out; rows that repeat score equally, and one of them teaches; a null doc_id is not held
out and has no label; texts of any length are read whole, in slices of bounded memory, and one
of more than a slice counts once for each of its slices where features are counted; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordweave.llm.shared import documents, written
from wordweave.llm.wordhash import mix, text_buffers
from wordweave.session import released, ship
from wordweave.sources.readers import table

#: Documents that teach at most, documents that a feature must be in, features that are learned at most.
SAMPLE, MIN_DOCS, VOCABULARY = 20_000, 5, 1 << 18
#: Shards that learn side by side, and rounds after each of which their states are averaged.
SHARDS, ROUNDS = 4, 8
#: FTRL-proximal: rate and its offset, L1 and L2.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 7.0, 0.0
#: Bytes of text that are hashed at once.
SLICE = 1 << 20
RESULT = "doc_id long, score double"

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(20250611).integers(1, 2**64, 256, dtype=np.uint64)
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PAIR, _SKIP = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Word hashes of stretches of bytes, with the powers of its base at hand."""

    def __init__(self, size: int = SLICE) -> None:
        self.size = size
        self.up = _powers(_BASE, size + 1)
        self.down = _powers(np.uint64(pow(int(_BASE), -1, 2**64)), size + 1)

    def runs(self, data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and polynomial sums of the words of at most `size` bytes. No word goes across a break."""
        word = _WORD_BYTE[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        inner = breaks[(breaks > 0) & (breaks < len(data))]
        before[inner] = False
        after[inner - 1] = False
        start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[_LOWER[data]] * self.up[: len(data)], out=total[1:])
        return start, end, (total[end] - total[start]) * self.down[start]

    @staticmethod
    def hashed(sums: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mix(sums + length.astype(np.uint64) * _STEP)

    def long_text(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """Hashes of a text's words, slice by slice. A word that a slice cuts is put together from the sums of its parts."""
        open_sum, open_len = 0, 0
        for lo in range(0, len(data), self.size):
            part = data[lo : lo + self.size]
            start, end, sums = self.runs(part, np.zeros(0, np.int64))
            length = end - start
            out, closed = [], open_len > 0
            if open_len and len(start) and start[0] == 0:
                open_sum = (open_sum + pow(int(_BASE), open_len, 2**64) * int(sums[0])) % 2**64
                open_len += int(length[0])
                closed = end[0] < len(part)
                start, end, sums, length = start[1:], end[1:], sums[1:], length[1:]
            if closed:
                out.append(self.hashed(np.array([open_sum], np.uint64), np.array([open_len])))
                open_sum, open_len = 0, 0
            if len(end) and end[-1] == len(part):
                open_sum, open_len = int(sums[-1]), int(length[-1])
                sums, length = sums[:-1], length[:-1]
            yield np.concatenate([*out, self.hashed(sums, length)]) if out else self.hashed(sums, length)
        if open_len:
            yield self.hashed(np.array([open_sum], np.uint64), np.array([open_len]))


def _features(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, documents): 32-bit hashes of words, neighbours and words with one between, not distinct."""
    near, far = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    two = mix(words[:-1][near] * _PAIR + words[1:][near])
    gap = mix(words[:-2][far] * _SKIP + words[2:][far])
    return (np.concatenate([words, two, gap]) >> np.uint64(32)).astype(np.uint32), np.concatenate([doc, doc[:-1][near], doc[:-2][far]])


def features(column: pa.Array, hasher: Hasher) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, rows) of a text column by slices; a long text is in several of them."""
    raw, offsets = text_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + hasher.size, "right")) - 1)
        part = offsets[lo : hi + 1] - offsets[lo]
        data = raw[offsets[lo] : offsets[hi]]
        if len(data) <= hasher.size:
            start, end, sums = hasher.runs(data, part)
            yield _features(hasher.hashed(sums, end - start), np.searchsorted(part, start, "right") - 1 + lo)
        else:
            last = np.zeros(0, np.uint64)
            for words in hasher.long_text(data):
                both = np.concatenate([last, words])
                found, _ = _features(both, np.zeros(len(both), np.int64))
                yield found, np.full(len(found), lo)  # the last two words' own features come twice, which is once where they are distinct
                last = both[-2:]
        lo = hi


class Known:
    """A sorted set of features, to be found among many others."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids
        self.coarse = np.zeros(1 << 20, bool)
        self.coarse[ids >> np.uint32(12)] = True

    def among(self, found: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and places in `ids` of the features that are there, distinct and in order."""
        maybe = self.coarse[found >> np.uint32(12)]
        found, row = found[maybe], row[maybe]
        at = np.searchsorted(self.ids, found)
        there = self.ids[np.minimum(at, max(0, len(self.ids) - 1))] == found if len(self.ids) else np.zeros(len(found), bool)
        code = np.unique(row[there].astype(np.int64) * (len(self.ids) + 1) + at[there])
        return code // (len(self.ids) + 1), code % (len(self.ids) + 1)

    def rows(self, column: pa.Array, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
        """The same for all texts of a column."""
        parts = [self.among(*part) for part in features(column, hasher)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = np.unique(np.concatenate([r for r, _ in parts]) * (len(self.ids) + 1) + np.concatenate([p for _, p in parts]))
        return code // (len(self.ids) + 1), code % (len(self.ids) + 1)


@dataclass
class State:
    """FTRL's sums: z of gradients, n of their squares, for each feature and, at the end, the bias."""

    z: np.ndarray
    n: np.ndarray

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def bias(self) -> float:
        """The last coordinate's weight, which neither L1 nor L2 hold back."""
        return float(-self.z[-1] / ((BETA + np.sqrt(self.n[-1])) / ALPHA))

    def learn(self, at: np.ndarray, toxic: float) -> None:
        """One document's step: `at` are its features' places."""
        w, b = self.weights(at), self.bias()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - toxic
        for places, weight in ((at, w), (np.array([len(self.z) - 1]), b)):
            n = self.n[places]
            self.z[places] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * weight
            self.n[places] = n + g * g


def begun(size: int, clean: int, toxic: int) -> State:
    """A state whose bias says the sample's odds and is as settled as if it had seen the sample; else every common word would learn them first."""
    out, odds = State(np.zeros(size), np.zeros(size)), toxic / clean
    out.n[-1] = clean * toxic / (clean + toxic)
    out.z[-1] = -np.log(odds) * (BETA + np.sqrt(out.n[-1])) / ALPHA
    return out


@dataclass
class Model:
    ids: np.ndarray  # features with a weight, sorted
    weights: np.ndarray
    bias: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _taught(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of labelled documents that are there and may teach, once each."""
    own = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return own.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).join(docs.select("doc_id"), "doc_id", "left_semi")


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """(doc_id, toxic, place, text) of at most `sample` labelled documents, and by label the number that there are and that teach."""
    taught = written(_taught(docs, labels), "labelled")
    there = {r.toxic: r.n for r in taught.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    half = sample // 2
    wanted = {y: min(n, max(half, sample - there.get(1 - y, 0))) for y, n in there.items()}
    # Below a threshold lie so many more than wanted that fewer are out of the question; of those the first are taken.
    share = {y: min(1.0, (1.2 * wanted[y] + 200) / n) for y, n in there.items()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / float(1 << 31)
    limit = F.lit(0.0)
    for y, s in share.items():
        limit = F.when(F.col("toxic") == y, s).otherwise(limit)
    few = taught.withColumn("place", place).filter(F.col("place") < limit)
    few = few.withColumn("i", F.row_number().over(Window.partitionBy("toxic").orderBy("place", "doc_id")))
    most = F.lit(0)
    for y, n in wanted.items():
        most = F.when(F.col("toxic") == y, n).otherwise(most)
    keys = few.filter(F.col("i") <= most).select("doc_id", "toxic", "place")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(keys), "doc_id")  # `sample` keys at most
    return rows.groupBy("doc_id", "toxic", "place").agg(F.min("text").alias("text")), {y: (n, wanted[y]) for y, n in there.items()}


def vocabulary(texts: DataFrame, least: int = MIN_DOCS, most: int = VOCABULARY) -> np.ndarray:
    """The `most` commonest features (of equal ones the least) in at least `least` of the texts (text), sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for found, row in features(batch.column(0), hasher):
                distinct = np.unique((row.astype(np.uint64) << np.uint64(32)) | found) & np.uint64(0xFFFFFFFF)
                ids, n = np.unique(distinct, return_counts=True)
                for lo in range(0, len(ids), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + (1 << 16)].astype(np.int64)), pa.array(n[lo : lo + (1 << 16)].astype(np.int64))], names=["id", "n"])

    rows = texts.select("text").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    best = rows.orderBy(F.desc("n"), "id").limit(most).select("id").toArrow()
    return np.sort(best.column("id").to_numpy().astype(np.uint32))


def _states(rows: pa.Table, size: int) -> State:
    """The mean of what the shards add; rows (shard, z, n) in any order, summed in the order of shards."""
    out = State(np.zeros(size), np.zeros(size))
    for r in sorted(rows.to_pylist(), key=lambda r: r["shard"]):
        out.z += np.frombuffer(r["z"], "<f4")
        out.n += np.frombuffer(r["n"], "<f4")
    return State(out.z / SHARDS, out.n / SHARDS)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic). The driver gets the vocabulary and the shards' states, which have a size of their own."""
    spark = ship(docs.sparkSession)
    rows, counts = sampled(docs, labels, sample)
    if len(counts) < 2:
        share = float(next(iter(counts), 0))
        return Model(np.zeros(0, np.uint32), np.zeros(0), 40.0 if share else -40.0)
    texts = written(rows, "teaching")
    ids = spark.sparkContext.broadcast(vocabulary(texts))
    size = len(ids.value) + 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hasher = Known(ids.value), Hasher()
        for batch in batches:
            row, place = known.rows(batch.column(2), hasher)
            offsets = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["place", "toxic", "at"])

    encoded = texts.select("place", "toxic", "text").mapInArrow(encode, "place double, toxic int, at array<int>")
    encoded = written(encoded.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(SHARDS)).cast("int")), "encoded")
    state = begun(size, *(counts[y][1] for y in (0, 1)))
    for _ in range(ROUNDS):
        common = spark.sparkContext.broadcast((state.z, state.n))

        def run(batches: Iterator[pa.RecordBatch], common=common) -> Iterator[pa.RecordBatch]:
            shard, own = None, None

            def added() -> pa.RecordBatch:
                z, n = (own.z - common.value[0]).astype("<f4"), (own.n - common.value[1]).astype("<f4")
                return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([z.tobytes()]), pa.array([n.tobytes()])], names=["shard", "z", "n"])

            for batch in batches:
                lists = batch.column(2)
                offsets, at = lists.offsets.to_numpy(), lists.values.to_numpy()
                for i, (s, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                    if s != shard:
                        if own is not None:
                            yield added()
                        shard, own = s, State(common.value[0].copy(), common.value[1].copy())
                    own.learn(at[offsets[i] : offsets[i + 1]], y)
            if own is not None:
                yield added()

        ordered = encoded.repartition(SHARDS, "shard").sortWithinPartitions("shard", "place")
        step = _states(ordered.select("shard", "toxic", "at").mapInArrow(run, "shard int, z binary, n binary").toArrow(), size)
        state = State(state.z + step.z, state.n + step.n)
    released(texts, encoded)
    w = state.weights()[:-1]
    (n0, s0), (n1, s1) = counts[0], counts[1]
    return Model(ids.value[w != 0], w[w != 0], state.bias() + float(np.log(n1 * s0 / (n0 * s1))))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """RESULT for each row of docs (doc_id, text)."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hasher = shared.value, Hasher()
        known = Known(m.ids)
        for batch in batches:
            row, place = known.rows(batch.column(1), hasher)
            logit = m.bias + np.bincount(row, m.weights[place] if len(place) else None, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(logit, -700, 700))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, RESULT)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
