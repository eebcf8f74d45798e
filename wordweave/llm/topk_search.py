"""Exact top-k search by inner product over an impact-ordered, score-at-a-time index.

Vectors become integers, floor(scale * x). Each block of vectors has an index of its own: for
each dimension, postings in segments of one quantised value. A query works through segments
of all dimensions by descending impact (query component times segment value), round by
round, until a proof ends it: after a round, what a vector can still gain from each dimension
it has not been seen in is at most that dimension's next impact. The vectors whose upper
bound reaches the k-th lower bound are the possible members; they are scored exactly.

Queries and vectors are cut into blocks of bounded bytes, and each pair of blocks is one row
of work; each pair returns k rows a query at most, and the best of those are the result.

Results in special cases: vectors that are null, or hold null or non-finite components, take
no part as queries or candidates; components beyond a vector's end are 0, and so are all of an
empty one; a vec_id that occurs twice is two candidates, and a row is no candidate of queries
of its own vec_id; a vec_id that occurs twice among the queries asks once, with the least of its
vectors; null vec_ids are left out; fewer than k candidates give as many rows; no query gives
no row; other columns are ignored. Any finite component takes part: vectors with scaled ones
beyond 2**22 have blocks of their own, are bounded in floating point with room for its errors and
scored with whole numbers of any size; a score beyond a long is shown as the nearest long and
ranked as what it is. Blocks hold vectors of like length, so long ones don't widen short ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordweave.llm.shared import written
from wordweave.session import ship

SCALE, K, QUERY_EVERY = 1024, 10, 100
#: Vectors of an index block, and queries of a query block, at most; bytes of either, of half of them, but for a single vector.
BLOCK, QUERY_BLOCK, BLOCK_BYTES = 16384, 512, 32 << 20
#: Quantised values of a dimension's segments lie this many bits apart from the components.
SHIFT = 5
ROUNDS = 24
#: Scaled components up to here have products and sums that 53 bits hold exactly.
NARROW = 2**22
#: Components of this size and more count as not finite. Floats are smaller.
MOST = 2.0**480
_BLOCKS = "n long, dims long, wide boolean, ids binary, data binary"
_HITS = "query_id long, vec_id long, score long, size binary"


def _packer(scale: int, size: int):
    """Arrow batches of (vec_id, embedding) to blocks of whole-number vectors, rows of one length; wide ones hold a component beyond NARROW, as doubles."""

    def emit(ids: list[np.ndarray], rows: list[np.ndarray], wide: bool) -> pa.RecordBatch:
        dims = max(x.shape[1] for x in rows)
        data = np.concatenate([np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in rows])
        values = [len(data), dims, wide, np.concatenate(ids).astype("<i8").tobytes(), data.astype("<f8" if wide else "<i4").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["n", "dims", "wide", "ids", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bool, int], tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for batch in batches:
            vec = batch.column(1)
            lengths = np.diff(np.asarray(vec.offsets))
            values = np.asarray(vec.flatten().to_numpy(zero_copy_only=False), np.float64)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            for dims in np.unique(lengths):
                at = np.flatnonzero(lengths == dims)
                scaled = np.floor(scale * values[starts[at][:, None] + np.arange(dims)])
                far = np.abs(scaled).max(1, initial=0) > NARROW
                for wide in (False, True):
                    own, x = at[far == wide], scaled[far == wide]
                    longest = 1 << int(dims).bit_length()  # vectors of a block are padded to less than twice their length
                    most = max(1, min(size, BLOCK_BYTES // (8 * longest)))
                    ids, rows = held.setdefault((wide, longest), ([], []))
                    for lo in range(0, len(own), most):
                        ids.append(np.asarray(batch.column(0))[own[lo : lo + most]])
                        rows.append(x[lo : lo + most])
                        if sum(map(len, ids)) >= most:
                            yield emit(ids, rows, wide)
                            ids.clear()
                            rows.clear()
        for (wide, _), (ids, rows) in held.items():
            if ids:
                yield emit(ids, rows, wide)

    return run


def exact_scores(data: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: in doubles where they are sure to hold them, else as Python's."""
    most = float(np.abs(data).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, len(q))
    if most < 2.0**53:
        return (data.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in data], object)


class ImpactIndex:
    """Segments (dimension, quantised value) of a block's vectors; a segment's postings are one run of `order`."""

    def __init__(self, ids: np.ndarray, data: np.ndarray):
        self.ids, self.data = ids, data
        n, dims = data.shape
        # Values in 2**SHIFT wide steps; of wide vectors the steps grow with the greatest component.
        most = float(np.abs(data).max(initial=0))
        self.width = 2.0 ** max(SHIFT, int(np.ceil(np.log2(most))) - 17 if most > NARROW else 0)
        level = np.floor(data / self.width)
        order = np.argsort(level, axis=0, kind="stable")
        self.order = np.ascontiguousarray(order.T).ravel()
        sorted_levels = np.take_along_axis(level, order, 0).T.ravel()
        dim = np.repeat(np.arange(dims), n)
        new = np.flatnonzero(np.concatenate([[True], (sorted_levels[1:] != sorted_levels[:-1]) | (dim[1:] != dim[:-1])])) if n * dims else np.zeros(0, np.int64)
        self.start, self.end = new, np.append(new[1:], n * dims)
        self.dim, self.level = dim[new], sorted_levels[new]
        self.read = 0  # postings that searches worked through

    def search(self, q: np.ndarray, q_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of the block's best k for q, and of all that tie with the last of them.

        A segment's impacts lie between `low` and `high`. What is still to come of a vector is at
        most the next segment's impact for each dimension not seen. Any round may end the search,
        as the possible members are then proved; it ends where scoring them all looks at no more
        components than the segments left have postings.
        """
        n = len(self.ids)
        own = self.ids == q_id
        if n - own.sum() <= k or not len(self.dim):
            at = np.flatnonzero(~own)
            return at, exact_scores(self.data[at], q)
        qd = q[self.dim].astype(np.float64)
        a, b = qd * self.level * self.width, qd * (self.level * self.width + self.width - 1)
        low, high = np.minimum(a, b), np.maximum(a, b)
        turn = np.argsort(-high, kind="stable")
        done = np.cumsum((self.end - self.start)[turn])
        cuts = np.searchsorted(done, np.linspace(0, done[-1], ROUNDS + 1)[1:], "left") + 1
        least = np.full(len(q), np.inf)
        np.minimum.at(least, self.dim, low)
        # Sums of least and of greatest impacts so far; where a dimension wasn't seen, its least of all counts in `lower`.
        lower, gained, seen = np.full(n, least.sum()), np.zeros(n), np.zeros(n)
        error = 4 * len(q) ** 2 * 2.0**-52 * float(np.abs(np.concatenate([low, high])).max())  # of sums in doubles; below 1 in narrow blocks
        at, possible = 0, np.flatnonzero(~own)
        for cut in cuts:
            if cut <= at:
                continue
            part = turn[at:cut]
            who = np.concatenate([self.order[x:y] for x, y in zip(self.start[part], self.end[part], strict=True)])
            each = (self.end - self.start)[part]
            lower += np.bincount(who, np.repeat(low[part] - least[self.dim[part]], each), n)
            gained += np.bincount(who, np.repeat(high[part], each), n)
            seen += np.bincount(who, minlength=n)
            at, left = cut, done[-1] - done[cut - 1]
            if left > 0.75 * done[-1]:
                continue
            bound = high[turn[at]] if at < len(turn) else 0.0
            upper = np.where(own, -np.inf, gained + (len(q) - seen) * bound)
            kth = np.partition(np.where(own, -np.inf, lower), n - k)[n - k]
            possible = np.flatnonzero(upper + error >= kth - error)
            if len(possible) * len(q) <= left or len(possible) <= 4 * k:
                break
        self.read += int(done[at - 1])
        scores = exact_scores(self.data[possible], q)
        best = np.sort(scores)[-k:][0]
        return possible[scores >= best], scores[scores >= best]


def _beyond(score: int) -> bytes:
    """Bytes that order scores at or beyond a long's ends as the numbers do; nothing for others, which are ordered already."""
    return b"" if abs(score) < 2**63 - 1 else (score + (1 << 1023)).to_bytes(128, "big")


def _search(k: int):
    long = np.iinfo(np.int64)

    def matrix(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(row[prefix + "data"], "<f8" if row[prefix + "wide"] else "<i4").reshape(row[prefix + "n"], row[prefix + "dims"])
        return np.frombuffer(row[prefix + "ids"], "<i8"), data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                if row["block"] != last:
                    index, last = ImpactIndex(*matrix(row, "")), row["block"]
                q_ids, qs = matrix(row, "q_")
                dims = row["dims"]
                qs = qs[:, :dims] if qs.shape[1] >= dims else np.pad(qs, ((0, 0), (0, dims - qs.shape[1])))
                hits: list[tuple[np.ndarray, ...]] = []
                for q_id, q in zip(q_ids, qs, strict=True):
                    at, scores = index.search(q, int(q_id), k)
                    ids = index.ids[at]
                    best = np.argsort(ids, kind="stable")
                    best = best[np.argsort(-scores[best], kind="stable")][:k]
                    hits.append((np.full(len(best), q_id), ids[best], np.clip(scores[best], long.min, long.max).astype(np.int64), np.array([_beyond(int(x)) for x in scores[best]], object)))
                cols = [np.concatenate([h[i] for h in hits]) for i in range(4)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in cols[:3]), pa.array(cols[3].tolist(), pa.binary())], names=["query_id", "vec_id", "score", "size"])

    return run


def blocks(vectors: DataFrame, scale: int, size: int) -> DataFrame:
    """vectors (vec_id, embedding) in blocks of less than twice `size`."""
    return vectors.mapInArrow(_packer(scale, size), _BLOCKS)


def taking_part(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST))
    good = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return good.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, size: int = BLOCK, query_size: int = QUERY_BLOCK) -> DataFrame:
    """The k vectors (vec_id, embedding) of highest score for each query (vec_id, embedding): query_id, rank, vec_id, score."""
    ship(vectors.sparkSession)
    index = written(blocks(taking_part(vectors), scale, size).withColumn("block", F.monotonically_increasing_id()), "topk-index")
    distinct = taking_part(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = blocks(distinct, scale, query_size).select(F.col("n").alias("q_n"), F.col("dims").alias("q_dims"), F.col("wide").alias("q_wide"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    asked = written(asked.withColumn("q_block", F.monotonically_increasing_id()), "topk-queries")
    # Every index block meets every query block. Pairs of names come first and fetch the query
    # blocks, then the index blocks, so that an index block is sent to one task only.
    numbers = asked.select("q_block", F.row_number().over(Window.orderBy("q_block")).alias("q"))
    pairs = index.select("block", F.explode(F.sequence(F.lit(1), F.lit(max(1, asked.count())))).alias("q"))
    work = pairs.join(numbers, "q").join(asked, "q_block").join(index, "block")
    hits = work.select("block", "n", "dims", "wide", "ids", "data", "q_n", "q_dims", "q_wide", "q_ids", "q_data").mapInArrow(_search(k), _HITS)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("size").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, rows.filter(F.col("vec_id") % QUERY_EVERY == 0))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, coalesce(list_sum(list_transform(list_zip(q.e, v.e), lambda x: coalesce(x[1] * x[2], 0))), 0)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
