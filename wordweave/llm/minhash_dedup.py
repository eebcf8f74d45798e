"""MinHash near-dedup: b-bit signatures, band candidates, links confirmed on whole sets.

A document's set is its distinct `shingle`-word shingles. Documents with equal sets form a
class at once; everything after is about one representative of each class. A signature keeps
the low `bits` bits of its minima, packed; bands of whole minima are hashed to buckets.

Within a bucket members meet its centre, one of them, and never every other one; of several
buckets' centres a member meets the few that it shares most buckets with. Pairs
whose similarity, estimated from equal low bits and corrected for chance agreement, lies well
below the threshold are left out; the others are confirmed on the sets themselves. Confirmed
links join components. A bucket whose members lie in one component is done: more links could
not change the result. The others go through `rounds` such rounds, none of which proposes a
pair again. Of what is then left of them, mostly documents of one template that are no copies,
members with too many shingles of their own cannot be linked; pairs of the others across
components are found by prefix filtering, which leaves out no link. What can be missed: a pair
of similarity 0.8 shares no band with odds of (1 - 0.8**rows)**bands, 3e-7 here (bands share
no minima), and its estimate lies below the floor with odds of 3e-7.

Results in special cases: null or empty text has an empty set and is linked with nothing; a
text of fewer words than a shingle has one, the whole sequence; a text of any length is hashed
whole; rows that agree in doc_id and text are one document, and each gets its result; a null
doc_id is a document like others, in a component of its own name if it is not linked; an empty
table gives an empty result; other columns are kept or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordweave.llm.shared import NULL_ID, documents, keyed, written
from wordweave.llm.wordhash import Words, mix, slices
from wordweave.session import released, ship


@dataclass(frozen=True)
class Plan:
    shingle: int = 5
    #: Links have 100 * |A and B| >= percent * |A or B|.
    percent: int = 80
    bands: int = 38
    rows: int = 5
    bits: int = 2
    #: Standard errors that an estimate may lie below the threshold.
    slack: float = 5.5
    rounds: int = 2
    spokes: int = 2
    #: Rarest shingles by which a pair is told that met before.
    ahead: int = 32

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    def estimate_floor(self) -> float:
        """The share of equal low bits below which a pair is no candidate.

        Equal with odds c + (1 - c) * J, c = 2**-bits the odds of chance agreement.
        """
        c, j = 2.0**-self.bits, self.percent / 100
        p = c + (1 - c) * j
        return p - self.slack * (p * (1 - p) / self.minima) ** 0.5


def _sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, and where each document's begin."""
    hashes, ok = w.shingles(k)
    n = np.diff(w.first)
    doc = w.doc_of_word()
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):  # the whole sequence as one
        for i in few:
            a = w.first[i]
            h = np.uint64(n[i])
            for x in w.hash[a : w.first[i + 1]]:
                h = mix(np.array([h ^ x], np.uint64))[0]
            hashes[a], ok[a] = h, True
    hashes, doc = hashes[ok], doc[ok]
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(w.n + 1))


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1709)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**64, n, dtype=np.uint64)


def _signatures(plan: Plan):
    """(did, tkey, text) to (did, tkey, n, set_a, set_b, signature, buckets); no signature or buckets for empty sets."""
    mul, add = _factors(plan.minima)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in slices(batch.column(2), lower=True, size=1 << 19):
                hashes, first = _sets(w, plan.shingle)
                n = np.diff(first)
                some = np.flatnonzero(n)
                starts = first[:-1][some]
                least = np.empty((len(some), plan.minima), np.uint32)
                sums = np.zeros((2, w.n), np.uint64)
                if len(some):
                    for j in range(plan.minima):
                        # The high half of a product mod 2^64 is a random order of the shingles.
                        least[:, j] = np.minimum.reduceat(((hashes * mul[j] + add[j]) >> np.uint64(32)).astype(np.uint32), starts)
                    sums[0, some] = np.add.reduceat(hashes, starts)
                    sums[1, some] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), starts)
                low = (least & np.uint32((1 << plan.bits) - 1)).astype(np.uint8)
                bits = np.packbits(np.unpackbits(low[:, :, None], axis=2, bitorder="little")[:, :, : plan.bits].reshape(len(some), -1), axis=1)
                keys = np.zeros((len(some), plan.bands), np.uint64)
                for r in range(plan.rows):
                    keys = mix(keys ^ (least[:, r :: plan.rows].astype(np.uint64) + np.uint64(r + 1)))
                keys = mix(keys + np.arange(plan.bands, dtype=np.uint64))
                packed, buckets = [None] * w.n, [None] * w.n
                for i, b, k in zip(some, bits, keys.view(np.int64), strict=True):
                    packed[i], buckets[i] = b.tobytes(), k
                rows = [batch.column(i).slice(w.lo, w.n) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(n), *(pa.array(x.view(np.int64)) for x in sums), pa.array(packed, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], names=["did", "tkey", "n", "set_a", "set_b", "signature", "buckets"])

    return run


def _close(plan: Plan):
    """Pairs (.., a_sig, b_sig) whose estimate allows a link."""
    floor = plan.estimate_floor()
    ones = np.array([bin(i).count("1") for i in range(256)], np.uint8)

    def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Share of minima with equal low bits."""
        x = a ^ b
        if plan.bits == 1:
            return 1 - ones[x].sum(1) / plan.minima
        if 8 % plan.bits:
            y = np.unpackbits(x, axis=1)[:, : plan.minima * plan.bits].reshape(len(x), plan.minima, plan.bits)
            return 1 - y.any(2).mean(1)
        # Fold each group of bits onto its first one, then count bits of whole bytes.
        folded, mask = x.copy(), sum(0x80 >> i for i in range(0, 8, plan.bits))
        for i in range(1, plan.bits):
            folded |= x << np.uint8(i)
        return 1 - ones[folded & np.uint8(mask)].sum(1) / plan.minima

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array(agree(a, b) >= floor))

    return run


def _linked(plan: Plan):
    """Pairs (a, b, a_text, b_text) that are links on their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        known: dict[int, np.ndarray] = {}

        def sets(ids, packed) -> list[np.ndarray]:
            todo = {i: p for i, p in zip(ids, packed, strict=True) if i not in known}
            if todo:
                texts = pa.array([unpacker.decompress(p) for p in todo.values()], pa.large_binary()).view(pa.large_string())
                names = list(todo)
                for w in slices(texts, lower=True):
                    hashes, first = _sets(w, plan.shingle)
                    for i in range(w.n):
                        known[names[w.lo + i]] = hashes[first[i] : first[i + 1]]
            return [known[i] for i in ids]

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                known.clear()
                a, b = (sets(part.column(i).to_pylist(), part.column(i + 2).to_pylist()) for i in (0, 1))
                good = []
                for x, y in zip(a, b, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * both >= plan.percent * (len(x) + len(y) - both))
                yield part.select([0, 1]).filter(pa.array(good))

    return run


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component), component the least node reachable. Least labels spread and are then looked up in each other, so rounds grow with the logarithm of a chain."""
    both = written(links.select("a", "b").union(links.select("b", "a")), "links")
    last = written(nodes.select("node", F.col("node").alias("component")).join(both.select(F.col("a").alias("node")).distinct(), "node", "left_semi"), "labels")
    while True:
        labels = last.select("node", "component")
        heard = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        nearer = labels.join(heard, "node").select("node", "component", F.least("component", "heard").alias("next"))
        known = labels.select(F.col("node").alias("next"), F.col("component").alias("jump"))
        moved = written(nearer.join(known, "next").select("node", F.col("component").alias("old"), F.least("next", "jump").alias("component")), "labels")
        released(last)
        last = moved
        if moved.filter("old <> component").isEmpty():
            break
    out = written(nodes.join(last.select("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "components")
    released(both, last)
    return out


def _confirmed(pairs: DataFrame, signed: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """pairs (a, b), distinct, that are links."""
    sig = signed.select("rep", "signature")
    near = pairs.join(sig.select(F.col("rep").alias("a"), F.col("signature").alias("a_sig")), "a").join(sig.select(F.col("rep").alias("b"), F.col("signature").alias("b_sig")), "b")
    near = written(near.select("a", "b", "a_sig", "b_sig").mapInArrow(_close(plan), "a long, b long"), "near")
    packed = texts.select("rep", "packed")
    both = near.join(packed.select(F.col("rep").alias("b"), F.col("packed").alias("b_text")), "b").join(packed.select(F.col("rep").alias("a"), F.col("packed").alias("a_text")), "a")
    out = written(both.select("a", "b", "a_text", "b_text").mapInArrow(_linked(plan), "a long, b long"), "confirmed")
    released(near)
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(did, tkey, text) with the text as zstandard."""
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = pa.array([packer.compress(x) for x in batch.column(2).cast(pa.binary()).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["did", "tkey", "packed"])


def _spokes(placed: DataFrame, tried: DataFrame | None, plan: Plan) -> DataFrame:
    """Pairs (a, b), none of them tried, of members (bucket, rep, size, component) and centres of their buckets where components differ.

    A bucket's centre is the member that meets most others over all buckets: an original,
    whose copies are closer to it than to each other. A member meets the `spokes` centres that
    it shares most buckets with; other centres, and other members, are left to what follows.
    """
    score = written(placed.groupBy("rep").agg(F.sum("size").alias("score")), "scores")
    order = F.struct((-F.col("score")).alias("s"), F.xxhash64("rep").alias("h"), "rep", "component")
    centre = placed.join(score, "rep").groupBy("bucket").agg(F.min(order).alias("c")).select("bucket", F.col("c.rep").alias("other"), F.col("c.component").alias("its"))
    centre = written(centre, "centres")
    met = placed.join(centre, "bucket").filter("component <> its").groupBy("rep", "other").agg(F.count(F.lit(1)).alias("shared"))
    met = met.select("rep", "other", "shared", F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b"))
    if tried is not None:
        met = met.join(tried, ["a", "b"], "left_anti")
    best = Window.partitionBy("rep").orderBy(F.desc("shared"), "other")
    met = met.withColumn("i", F.row_number().over(best)).filter(F.col("i") <= plan.spokes)
    out = written(met.select("a", "b").distinct(), "pairs")
    released(score, centre)
    return out


def _whole_sets(plan: Plan, ids: list[int], packed: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in ids of non-empty sets, hashes, where each set begins) of packed texts."""
    unpacker = zstandard.ZstdDecompressor()
    for at in range(0, len(ids), 256):
        texts = pa.array([unpacker.decompress(p) for p in packed[at : at + 256]], pa.large_binary()).view(pa.large_string())
        for w in slices(texts, lower=True):
            hashes, first = _sets(w, plan.shingle)
            some = np.flatnonzero(np.diff(first))
            if len(some):
                yield at + w.lo + some, hashes, first[:-1][some]


def _shingles(plan: Plan):
    """(rep, packed) to (rep, shingle), every shingle of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = np.asarray(batch.column(0))
            for at, hashes, first in _whole_sets(plan, reps.tolist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(reps[at], np.diff(np.append(first, len(hashes))))), pa.array(hashes.view(np.int64))], names=["rep", "shingle"])

    return run


def _rest(placed: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b) across components of the members left in buckets of several components: every link is among them.

    Of a member's n shingles, c occur in other components as well. It shares c with members of
    those at most, so a link needs c / n, and with one of m shingles, d of them in others, the
    lesser of c and d out of n + m less that, to reach the threshold. Copies with many edits of
    their own fail that by themselves, without a look at any pair.

    A link shares the threshold's part of n at least, so with shingles in one order, rare ones
    first, the first shared one is among the first n less that part, plus 1, of both. Pairs meet
    there, and only if what lies behind in both is enough. `ahead` shingles tell whether a pair
    met at one before.
    """
    part = lambda n: F.floor((F.lit(plan.percent) * n + 99) / 100)
    enough = lambda both, n, m: F.lit(100) * both >= F.lit(plan.percent) * (n + m - both)
    able = written(placed.select("rep", "component", "n").distinct(), "rest")
    rows = texts.join(able.select("rep"), "rep", "left_semi").select("rep", "packed").mapInArrow(_shingles(plan), "rep long, shingle long")
    rows = written(rows.join(able.select("rep", "component"), "rep"), "shingles")
    for _ in range(2):  # those that cannot be linked share nothing with the others
        before, rows = rows, rows.join(able.select("rep"), "rep", "left_semi")
        common = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("shingle", "k")
        rows = written(rows.select("rep", "component", "shingle").join(common, "shingle"), "shared")
        released(before)
        c = rows.groupBy("rep").agg(F.count(F.lit(1)).alias("c"))
        before, able = able, written(able.select("rep", "component", "n").join(c, "rep").filter(F.lit(100) * F.col("c") >= F.lit(plan.percent) * F.col("n")), "able")
        released(before)
    order = F.array_sort(F.collect_list(F.struct("k", "shingle"))).getField("shingle")
    first = rows.groupBy("rep").agg(order.alias("first")).join(able, "rep")
    first = first.withColumn("first", F.slice("first", F.lit(1), (F.col("c") - part(F.col("n")) + 1).cast("int")))
    prefixes = written(first.select("rep", "component", "n", "c", F.slice("first", 1, plan.ahead).alias("ahead"), F.posexplode("first").alias("at", "shingle")), "prefixes")
    released(rows, able)
    first = prefixes.withColumn("ahead", F.slice("ahead", F.lit(1), F.least(F.col("at"), F.lit(plan.ahead))))
    other = first.select("shingle", *[F.col(x).alias(f"its_{x}") for x in ("rep", "component", "n", "c", "at", "ahead")])
    far = lambda x: F.greatest(F.col(x) - F.lit(plan.ahead), F.lit(0))
    before = F.least("at", "its_at", far("at") + far("its_at"))
    behind = F.least(F.col("c") - F.col("at"), F.col("its_c") - F.col("its_at"))
    may = (F.col("rep") < F.col("its_rep")) & (F.col("component") != F.col("its_component")) & enough(F.least("c", "its_c"), F.col("n"), F.col("its_n"))
    may = may & enough(before + behind, F.col("n"), F.col("its_n")) & ~F.arrays_overlap("ahead", "its_ahead")
    out = written(first.join(other, "shingle").filter(may).select(F.col("rep").alias("a"), F.col("its_rep").alias("b")).distinct(), "pairs")
    released(prefixes)
    return out


def classes(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(did, tkey, n_shingles, first) for each document; first: (did, tkey) of the least document of its component."""
    ship(docs.sparkSession)
    keys = keyed(docs).select("did", "tkey", F.coalesce("text", F.lit("")).alias("text"))
    signed = written(keys.mapInArrow(_signatures(plan), "did long, tkey long, n long, set_a long, set_b long, signature binary, buckets array<long>"), "signatures")
    # Equal sets: the least document stands for the class, under a number of its own.
    alike = signed.filter("n > 0").groupBy("n", "set_a", "set_b").agg(F.min(F.struct("did", "tkey", "signature", "buckets")).alias("one"))
    alike = written(alike.select("n", "set_a", "set_b", F.struct("one.did", "one.tkey").alias("doc"), F.xxhash64("one.did", "one.tkey").alias("rep"), "one.signature", "one.buckets"), "classes")
    every = alike.select("rep", "n", F.explode("buckets").alias("bucket"))
    shared = written(every.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    members = written(every.join(shared, "bucket"), "members")
    released(shared)
    met = written(members.select("rep").distinct(), "nodes")
    chosen = alike.join(met, "rep", "left_semi").select("rep", "doc.did", "doc.tkey")
    texts = keys.mapInArrow(_packed, "did long, tkey long, packed binary").join(chosen.hint("shuffle_hash"), ["did", "tkey"]).select("rep", "packed").dropDuplicates(["rep"])
    texts = written(texts, "texts")
    nodes = met.select(F.col("rep").alias("node"))
    links, tried, done, labels = None, None, [], nodes.withColumn("component", F.col("node"))
    for turn in range(plan.rounds + 1):
        placed = members.select("bucket", "rep", "n", "size").join(labels.select(F.col("node").alias("rep"), "component"), "rep")
        # Buckets that still hold several components.
        unsure = written(placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket"), "unsure")
        before, members = members, written(placed.join(unsure, "bucket").select("bucket", "rep", "n", "size", "component"), "members")
        released(before, unsure)
        if members.isEmpty():
            break
        pairs = _spokes(members, tried, plan) if turn < plan.rounds else _rest(members, texts, plan)
        done.append(pairs)
        tried = pairs if tried is None else tried.union(pairs)
        found = _confirmed(pairs, alike, texts, plan)
        if links is None:
            links = found
        else:
            before, links = links, written(links.union(found), "links")
            released(before, found)
        before, labels = labels, components(nodes, links)
        released(before)
    released(members, texts, links, *done)
    of_class = alike.select("n", "set_a", "set_b", "doc", "rep").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    of_class = written(of_class.select("n", "set_a", "set_b", "doc", F.coalesce("component", "rep").alias("component")), "labelled")
    released(alike, labels, met)
    first = written(of_class.groupBy("component").agg(F.min("doc").alias("first")), "firsts")
    named = written(of_class.join(first, "component").select("n", "set_a", "set_b", "first"), "named")
    released(of_class, first)
    out = signed.select("did", "tkey", "n", "set_a", "set_b").join(named, ["n", "set_a", "set_b"], "left")
    return out.select("did", "tkey", F.col("n").alias("n_shingles"), F.coalesce("first", F.struct("did", "tkey")).alias("first"))


def near_deduplicated(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """docs without the documents that a smaller one of their component stands for, all columns as they are."""
    gone = written(classes(docs, plan).filter(F.col("first") != F.struct("did", "tkey")).select("did", "tkey").distinct(), "near-copies").hint("shuffle_hash")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(text).alias("tkey"))
    return rows.join(gone, ["did", "tkey"], "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    out = classes(documents(spark, sf_dir), Plan(shingle=4))
    return out.select(real("did").alias("doc_id"), "n_shingles", real("first.did").alias("component_id"), (F.col("did") == F.col("first.did")).alias("kept"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS k FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * p.k >= 80 * (x.n + y.n - p.k)),
r AS (SELECT a AS doc_id, a AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT doc_id, min(other) AS c FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
