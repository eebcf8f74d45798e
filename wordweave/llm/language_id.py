"""Language ID by error-correcting output codes over byte n-grams.

Each learned language has a codeword; for each of its bits a logistic model over hashed byte
1- to 3-grams (lower-cased ASCII, within and across words) says which half of the languages a
text belongs to. A text goes to the codeword of least summed logistic loss under the bits'
margins, each bit weighed by its accuracy in training; a small lead over the second codeword
marks the text ambiguous.

The models are fit on the driver from a sample of at most `sample` different labelled
documents, the same number of each language and the first by a hash of doc_id and text, so it
is the same at each run and does not grow. Languages are counted first; only documents whose
hash lies below their language's threshold, a few times the sample, are then ordered, so no
task gets the rows of a common language. Of more languages than `sample` the commonest are
learned. What is broadcast is the models, `buckets` weights a bit, and the sample's keys.

Results in special cases: null text, or text without a letter, is `und` with score 0, as is
every text if nothing could be learned; with one learned language every other text is that
language; texts of any length are counted whole; rows that repeat give equal rows and teach
once; rows with
null doc_id, lang or text teach nothing; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordweave.llm.shared import documents
from wordweave.llm.wordhash import text_buffers
from wordweave.session import ship

#: Documents that the models learn from at most; buckets of hashed n-grams; bytes that are counted at once.
SAMPLE, BUCKETS, SLICE = 2000, 4096, 1 << 20
#: Of the probability of the best codeword over the second best.
AMBIGUOUS = 2.0
RESULT = "doc_id long, lang_pred string, score double, second string, ambiguous boolean"


def codewords(n: int) -> np.ndarray:
    """n rows of 0 and 1, far from each other: all splits of up to 7 languages, else 15 * log2(n) columns of the best of many random codes."""
    if n <= 1:
        return np.zeros((n, 0), np.int8)
    if n <= 7:
        splits = np.arange(1, 2 ** (n - 1))
        return (splits[None, :] >> np.arange(n)[:, None] & 1).astype(np.int8)
    rng, bits = np.random.default_rng(31), int(np.ceil(15 * np.log2(n)))
    best, best_gap = None, -1
    for _ in range(200):
        code = rng.integers(0, 2, (n, bits), dtype=np.int8)
        balanced = (code.sum(0) > 0) & (code.sum(0) < n)
        gap = min((code[i] != code[j])[balanced].sum() for i in range(n) for j in range(i))
        if gap > best_gap:
            best, best_gap = code[:, balanced], gap
    return best


_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
#: Digits, white space and ASCII punctuation say little of a language; they count as one separator.
_ASCII_LOWER[[i for i in range(128) if not chr(i).isalpha()]] = 32


def profiles(column: pa.Array, buckets: int = BUCKETS) -> np.ndarray:
    """A row for each text: shares of its hashed byte n-grams, their square roots scaled to length 1."""
    raw, offsets = text_buffers(column)
    out = np.zeros((len(offsets) - 1, buckets), np.float32)
    for i in range(len(offsets) - 1):
        counts = np.zeros(buckets, np.int64)
        for lo in range(int(offsets[i]), int(offsets[i + 1]), SLICE):
            part = _ASCII_LOWER[raw[lo : min(lo + SLICE + 2, int(offsets[i + 1]))]].astype(np.uint32)
            grams = [part, part[:-1] * np.uint32(263) + part[1:] + np.uint32(1 << 20), (part[:-2] * np.uint32(263) + part[1:-1]) * np.uint32(263) + part[2:] + np.uint32(1 << 28)]
            for g in grams:
                g = g[:SLICE]
                counts += np.bincount(((g * np.uint32(2654435761)) >> np.uint32(32 - int(buckets).bit_length() + 1)).astype(np.int64), minlength=buckets)
        root = np.sqrt(counts.astype(np.float32))
        out[i] = root / max(1e-9, float(np.sqrt((root * root).sum())))
    return out


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codewords in order, nearest first, and their probabilities in that order."""
        margin = x @ self.weights + self.bias
        sign = 2.0 * self.code - 1
        loss = np.stack([(self.trust * np.logaddexp(0, -margin * s)).sum(1) for s in sign], 1)
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        order = np.argsort(-p, axis=1, kind="stable")
        return order, np.take_along_axis(p, order, 1)


def fit(x: np.ndarray, lang: list[str], steps: int = 300, rate: float = 8.0, decay: float = 1e-5) -> Model:
    """One logistic model for each bit, by gradient descent with momentum on all rows at once."""
    langs = sorted(set(lang))
    code = codewords(len(langs))
    y = code[[langs.index(v) for v in lang]].astype(np.float32) if lang else np.zeros((0, 0), np.float32)
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    if y.size:
        for _ in range(steps):
            g = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) / len(x)
            vw = 0.9 * vw - rate * (x.T @ g + decay * w)
            vb = 0.9 * vb - rate * g.sum(0)
            w, b = w + vw, b + vb
    right = ((x @ w + b > 0) == (y > 0.5)).mean(0) if y.size else np.ones(y.shape[1])
    return Model(langs, code, w, b, np.clip(2 * right - 1, 0.05, 1))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sampled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most `sample` different rows (doc_id, lang, text) of those that may teach, as many of each language as of others if it has them."""
    teach = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    teach = teach.select("doc_id", "lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    counts = teach.groupBy("lang").agg(F.approx_count_distinct("key").alias("n"), F.count(F.lit(1)).alias("rows"))
    counts = counts.orderBy(F.desc("rows"), "lang").limit(sample).collect()  # `sample` rows at most
    each = max(1, sample // max(1, len(counts)))
    # So many times the rows wanted, and some, lie below a threshold that fewer than `each` are out of the question.
    limits = docs.sparkSession.createDataFrame([(r.lang, min(1.0, (3 * each + 30) / max(1, r.n))) for r in counts], "lang string, share double")
    place = (F.pmod("key", F.lit(1 << 31)) / float(1 << 31)).alias("place")
    few = teach.select("doc_id", "lang", "key", place).join(F.broadcast(limits), "lang").filter("place < share").select("lang", "place", "key").distinct()
    first = Window.partitionBy("lang").orderBy("place", "key")
    keys = few.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= each).select("lang", "key")
    return teach.join(F.broadcast(keys), ["lang", "key"]).dropDuplicates(["lang", "key"]).select("doc_id", "lang", "text")


def train(docs: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS) -> Model:
    """Models from docs (doc_id, text, lang). Profiles are counted on the executors; the driver gets `sample` rows of 2 * buckets bytes."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = profiles(part.column(2), buckets).astype("<f2")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "lang", "profile"])

    rows = sampled(docs, sample).mapInArrow(count, "doc_id long, lang string, profile binary").toArrow().to_pylist()
    rows = sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["profile"]))
    x = np.frombuffer(b"".join(r["profile"] for r in rows), "<f2").reshape(-1, buckets).astype(np.float32)
    return fit(x, [r["lang"] for r in rows])


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """RESULT for each row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n = part.num_rows
                letters = np.asarray(part.column(2))
                best, second = np.full(n, "und", object), np.full(n, None, object)
                score, close = np.zeros(n), np.zeros(n, bool)
                if m.langs:
                    order, p = m.decode(profiles(part.column(1), m.weights.shape[0] or BUCKETS))
                    langs = np.array(m.langs, object)
                    best = np.where(letters, langs[order[:, 0]], "und")
                    score = np.where(letters, p[:, 0], 0.0)
                    if len(langs) > 1:
                        second = np.where(letters, langs[order[:, 1]], None)
                        close = letters & (p[:, 0] < AMBIGUOUS * p[:, 1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.string()), pa.array(score), pa.array(second, pa.string()), pa.array(close)], names=["doc_id", "lang_pred", "score", "second", "ambiguous"])

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), text.rlike(r"\p{L}").alias("letters")).mapInArrow(run, RESULT)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = predicted(docs, train(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "second", "ambiguous")
