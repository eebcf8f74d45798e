"""Substring dedup by Relative Lempel-Ziv parsing of documents against indexed reference blocks.

The reference is every document that holds the first occurrence of some window of `width`
words that occurs again, cut into blocks of about `block` bytes as packed, or of one longer
document. A block's index is a sorted array of its windows' hashes with their places. A
document is factored greedily against a block: at the first word whose window the block has at
an earlier place, the factor is what follows there, as far as the two agree word by word; then
the parse goes on at the windows that reach over the factor's end, each of which is looked up
again, so that no window across a border is missed. Agreement is proved on the words' bytes,
not on hashes. Factors have `width` words at least and are the duplicate spans; what one
document's blocks say is united, and a factor inside another is dropped. A document's own
earlier words are one more block for it.

A directory says which blocks a document has to be factored against: those that hold the
earliest document with one of its windows. Every other block could only repeat what these
find. Few windows need an entry there. Each window has an anchor, the least hash of its
`seed`-word grams; equal windows have equal anchors, and an anchor is the same for several
windows in a row. Only windows whose anchor occurs in different texts enter the directory.

The documents of a block are dealt to tasks by `share`, each of which gets the block's texts
first, so a block that every document needs is read by many tasks, and a task holds one index
and one batch. Anchors and windows are combined before they are shuffled.

Documents whose whole texts are equal are found by two hashes of them: the first is parsed,
each other is one factor.

Results in special cases: null or empty text has no words, keeps the empty text and loses
nothing; texts of any length are parsed whole; documents go by doc_id, null before all others;
different texts of one doc_id count as one document whose windows go by their starts; rows
that agree in doc_id and text are one document, which is not its own earlier copy, and each of
them gets its result; an empty table gives an empty result; other columns are ignored. Of n
directory windows two different ones share a hash with odds of about n * n / 2**65; then a
document may miss a block, but no word is removed without a proof. Two of n texts are taken
for one with odds of n * n / 2**129.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordweave.llm.shared import documents, keyed, written
from wordweave.llm.wordhash import Words, mix, slices
from wordweave.session import released, ship

#: Bytes of a reference block as packed, and the documents that a task factors against it.
WIDTH, SEED, BLOCK, SHARE = 20, 8, 1 << 19, 2048
#: Packed bytes that are unpacked at once.
UNPACKED = 1 << 17
#: Columns of a document that is factored.
FACTORS = "array<struct<start:int,len:int,source:long,source_start:int>>"
PARSED = "doc_id long, n_words long, n_removed long, kept_sha256 string, factors " + FACTORS


def _anchor_runs(w: Words, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor occurrence: first word of the first window, number of windows, the anchor's hash."""
    _, ok = w.shingles(width)
    at = np.flatnonzero(ok)
    grams, _ = w.shingles(seed)
    least, where = grams.copy(), np.arange(len(grams))
    have, want = 1, width - seed + 1
    while have < want:  # least of `want` grams in a row, leftmost first, from halves that overlap
        step = min(have, want - have)
        other = np.full_like(least, np.iinfo(np.uint64).max)
        place = np.zeros_like(where)
        other[:-step], place[:-step] = least[step:], where[step:]
        right = other < least
        least, where = np.where(right, other, least), np.where(right, place, where)
        have += step
    if not len(at):
        return at, at, least[:0]
    spot = where[at]
    new = np.flatnonzero(np.concatenate([[True], (spot[1:] != spot[:-1]) | (at[1:] != at[:-1] + 1)]))
    return at[new], np.diff(np.append(new, len(at))), least[at[new]]


def _first_words(w: Words, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document of each word, and the word's place in it."""
    doc = np.searchsorted(w.first, word, "right") - 1
    return doc, word - w.first[doc]


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _anchors(width: int, seed: int):
    """(did, tkey, text) to (anchor, did, tkey, start, len, again); again: the anchor occurs elsewhere in the same text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, tkey = (np.asarray(batch.column(i)) for i in (0, 1))
            for w in slices(batch.column(2)):
                start, number, anchor = _anchor_runs(w, width, seed)
                doc, place = _first_words(w, start)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(did[w.lo + doc]), pa.array(tkey[w.lo + doc]), pa.array(place.astype(np.int32)), pa.array(number.astype(np.int32)), pa.array(_repeats(mix(anchor ^ mix(doc.astype(np.uint64)))))], names=["anchor", "did", "tkey", "start", "len", "again"])

    return run


def _unpacked(packed: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Texts of a column of packed ones, by bounded runs of rows, with the first row of each."""
    unpacker, values = zstandard.ZstdDecompressor(), packed.to_pylist()
    lo, held = 0, 0
    for i, x in enumerate(values, 1):
        held += len(x)
        if held >= UNPACKED or i == len(values):
            yield lo, pa.array([unpacker.decompress(v) for v in values[lo:i]], pa.large_binary()).view(pa.large_string())
            lo, held = i, 0


def _windows(width: int):
    """(did, packed, runs) to the windows of the runs, each once a document: (window, did, tkey)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, tkey = (np.asarray(batch.column(i)) for i in (0, 1))
            for row, texts in _unpacked(batch.column(2)):
                for w in slices(texts):
                    hashes, _ = w.shingles(width)
                    at = row + w.lo
                    part = batch.column(3).slice(at, w.n)
                    flat = part.flatten()
                    number = np.diff(np.asarray(part.offsets))
                    start, length = (np.asarray(flat.field(i)).astype(np.int64) for i in (0, 1))
                    doc = np.repeat(np.repeat(np.arange(w.n), number), length)
                    within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                    window = hashes[w.first[doc] + np.repeat(start, length) + within]
                    order = np.lexsort((window, doc))
                    window, doc = window[order], doc[order]
                    new = np.ones(len(doc), bool)
                    new[1:] = (window[1:] != window[:-1]) | (doc[1:] != doc[:-1])
                    window, doc = window[new], doc[new]
                    yield pa.RecordBatch.from_arrays([pa.array(window.view(np.int64)), pa.array(did[at + doc]), pa.array(tkey[at + doc])], names=["window", "did", "tkey"])

    return run


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning of two arrays, a few elements of which are looked at if it is short."""
    n, lo, step = min(len(a), len(b)), 0, 64
    while lo < n:
        hi = min(n, lo + step)
        other = np.flatnonzero(a[lo:hi] != b[lo:hi])
        if len(other):
            return lo + int(other[0])
        lo, step = hi, 2 * step
    return n


class Block:
    """Reference texts, whose words have one space between them, and the index of their windows."""

    def __init__(self, dids: np.ndarray, texts: pa.Array, width: int):
        self.width = width
        self.words = w = next(slices(texts, size=1 << 62))
        hashes, ok = w.shingles(width)
        at = np.flatnonzero(ok)
        doc, place = _first_words(w, at)
        order = np.lexsort((place, dids[doc], hashes[at]))
        self.key, self.at, self.did, self.place = hashes[at][order], at[order], dids[doc][order], place[order]
        self.last = w.first[doc + 1][order]  # word after the document's last one
        new = np.ones(len(order), bool)
        new[1:] = self.key[1:] != self.key[:-1]
        self.first = np.flatnonzero(new)
        self.names = self.key[self.first]

    def _match(self, w: Words, word: int, last: int, i: int) -> int:
        """Words that agree with the block's from its place i on, proved on their bytes."""
        own, at = self.words, self.at[i]
        n = _agree(w.hash[word:last], own.hash[at : self.last[i]])
        if n < self.width:
            return 0
        a, b = (x.data[x.start[k] : x.end[k + n - 1]] for x, k in ((w, word), (own, at)))
        if np.array_equal(a, b):
            return n
        same = 0  # two different words share a hash
        for x, y in zip(a.tobytes().split(), b.tobytes().split(), strict=True):
            if x != y:
                break
            same += 1
        return same if same >= self.width else 0

    def factors(self, w: Words, hashes: np.ndarray, doc: int, did: int) -> list[tuple[int, int, int, int]]:
        """Factors (start, len, source, source_start) of a document of w, greedily from left to right; hashes are w's windows'."""
        begin, last = int(w.first[doc]), int(w.first[doc + 1])
        n = last - begin - self.width + 1
        if n <= 0 or not len(self.names):
            return []
        window = hashes[begin : begin + n]
        where = np.minimum(np.searchsorted(self.names, window), len(self.names) - 1)
        at = self.first[where]
        earlier = (self.did[at] < did) | ((self.did[at] == did) & (self.place[at] < np.arange(n)))
        spots = np.flatnonzero((self.names[where] == window) & earlier)
        out, k = [], 0
        while k < len(spots):
            i = int(spots[k])
            j, length = int(at[i]), 0
            while not length and j < len(self.key) and self.key[j] == window[i] and (self.did[j] < did or (self.did[j] == did and self.place[j] < i)):
                length = self._match(w, begin + i, last, j)
                j += 1
            if length:
                out.append((i, length, int(self.did[j - 1]), int(self.place[j - 1])))
                k = int(np.searchsorted(spots, i + length - self.width + 1))
            else:
                k += 1
        return out


_KIND = pa.list_(pa.struct([("start", pa.int32()), ("len", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))


def _listed(factors: list[list[tuple[int, int, int, int]]]) -> pa.Array:
    return pa.array([[dict(zip(("start", "len", "source", "source_start"), f, strict=True)) for f in x] for x in factors], _KIND)


def _factored(width: int):
    """(block, part, kind, did, tkey, packed), a block's texts (kind 0) before its documents (kind 1), to (did, tkey, factors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in batches:
            name = np.stack([np.asarray(batch.column(i)) for i in range(3)], 1)
            did = np.asarray(batch.column(3))
            cuts = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]).any(1), [True]])) if len(name) else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if now != tuple(name[lo, :2]):
                    now, held, block = tuple(name[lo, :2]), [], None
                rows = batch.slice(lo, hi - lo)
                if name[lo, 2] == 0:
                    held.append((did[lo:hi], pa.concat_arrays([x for _, x in _unpacked(rows.column(5))])))
                    continue
                if block is None:
                    block, held = Block(np.concatenate([d for d, _ in held]), pa.concat_arrays([t for _, t in held]), width), []
                for row, texts in _unpacked(rows.column(5)):
                    for w in slices(texts):
                        hashes, _ = w.shingles(width)
                        at = lo + row + w.lo
                        found = [block.factors(w, hashes, j, int(did[at + j])) for j in range(w.n)]
                        yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, w.n) for i in (3, 4)), _listed(found)], names=["did", "tkey", "factors"])

    return run


def united(factors: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The factors of several blocks in order, without those inside another."""
    out, upto = [], -1
    for f in sorted(factors, key=lambda f: (f[0], -f[1], f[2], f[3])):
        if f[0] + f[1] > upto:
            out.append(f)
            upto = f[0] + f[1]
    return out


def kept_words(text: bytes, factors: list[tuple[int, int, int, int]]) -> tuple[int, list[bytes]]:
    """Number of words of a text, and those outside all factors."""
    words = text.split()  # bytes split at the very characters that words exclude
    gone = np.zeros(len(words) + 1, np.int32)
    for start, length, _, _ in factors:
        gone[start] += 1
        gone[start + length] -= 1
    out = np.cumsum(gone[:-1]) > 0
    return len(words), [x for x, g in zip(words, out, strict=True) if not g]


def _kept(width: int):
    """(did, tkey, packed, own, factors) to all factors and what they leave; own: the text repeats words of itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, own = np.asarray(batch.column(0)), batch.column(3)
            removed, shas, lists = [], [], []
            for row, texts in _unpacked(batch.column(2)):
                for j, text in enumerate(texts):
                    i = row + j
                    factors = [(f["start"], f["len"], f["source"], f["source_start"]) for f in batch.column(4)[i].as_py() or ()]
                    if own[i].as_py():
                        block = Block(did[i : i + 1], texts.slice(j, 1), width)
                        hashes, _ = block.words.shingles(width)
                        factors += block.factors(block.words, hashes, 0, int(did[i]))
                    factors = united(factors)
                    n, kept = kept_words(text.as_py().encode(), factors)
                    removed.append(n - len(kept))
                    shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                    lists.append(factors)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), _listed(lists)], names=["did", "tkey", "removed", "sha", "factors"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(did, tkey, text) with the words, one space between, as zstandard: half of what Spark's own compression makes of a text in a shuffle."""
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = pa.array([packer.compress(b" ".join(x.split())) for x in batch.column(2).cast(pa.binary()).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["did", "tkey", "packed"])


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, did, tkey, tkey2, text) to what holds of a document that loses nothing. Words of one document are held at a time."""
    for batch in batches:
        n, whole = [], []
        for text in batch.column(4):
            words = text.as_py().encode().split()
            n.append(len(words))
            whole.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(n, pa.int64()), pa.array(whole, pa.string())], names=["doc_id", "did", "tkey", "tkey2", "n_words", "whole"])


def _candidates(keys: DataFrame, first: DataFrame, width: int, seed: int) -> DataFrame:
    """(did, tkey, packed, runs, own) of the texts that may lose words, first of equal ones: runs of windows whose anchors other texts have, and whether an anchor occurs twice in this one."""
    texts = keys.select("did", "tkey", "text")
    runs = texts.mapInArrow(_anchors(width, seed), "anchor long, did long, tkey long, start int, len int, again boolean")
    counted = runs.groupBy("anchor").agg(F.min("tkey").alias("lo"), F.max("tkey").alias("hi"), F.max("again").alias("again"))
    twice = written(counted.filter("lo <> hi or again").select("anchor", (F.col("lo") != F.col("hi")).alias("across")), "rlz-anchors")
    found = runs.join(twice, "anchor").groupBy("did", "tkey").agg(F.collect_set(F.when(F.col("across"), F.struct("start", "len"))).alias("runs"), F.max("again").alias("own"))
    found = found.join(first, ["did", "tkey"], "left_semi")
    packed = texts.mapInArrow(_packed, "did long, tkey long, packed binary").join(found.hint("shuffle_hash"), ["did", "tkey"])
    out = written(packed.select("did", "tkey", "packed", "runs", "own"), "rlz-parts")
    released(twice)
    return out


def _by_blocks(parts: DataFrame, several: DataFrame, width: int, block: int, share: int) -> DataFrame:
    """(did, tkey, factors) of parts against every block that their windows name."""
    index = written(parts.filter(F.size("runs") > 0).select("did", "tkey", "packed", "runs").mapInArrow(_windows(width), "window long, did long, tkey long"), "rlz-windows")
    earliest = written(index.groupBy("window").agg(F.min("did").alias("lo"), F.max("did").alias("hi")).filter("lo <> hi").select("window", "lo"), "rlz-directory")
    sources = index.join(earliest, "window").filter("did > lo").select("did", "tkey", "lo")
    # Texts of one doc_id meet among themselves, as the directory knows documents only.
    own = parts.join(several, "did").select("did", "tkey", F.col("did").alias("lo"))
    sources = written(sources.union(own).distinct(), "rlz-sources")
    released(index, earliest)
    texts = parts.select("did", "tkey", "packed")
    reference = written(texts.join(sources.select(F.col("lo").alias("did")).distinct(), "did").select("did", "tkey", "packed"), "rlz-reference")
    size = reference.agg(F.coalesce(F.sum(F.length("packed")), F.lit(0))).first()[0]
    of = lambda did: F.pmod(F.xxhash64(did), F.lit(max(1, -(-size // block))).cast("long")).alias("block")
    pairs = written(sources.select("did", "tkey", of("lo")).distinct(), "rlz-pairs")
    shares = written(pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / share).cast("long").alias("shares")), "rlz-shares")
    asked = pairs.join(shares, "block").select("block", F.pmod(F.xxhash64("did", "tkey"), F.col("shares")).alias("part"), F.lit(1).cast("long").alias("kind"), "did", "tkey")
    asked = asked.join(texts, ["did", "tkey"]).select("block", "part", "kind", "did", "tkey", "packed")
    given = reference.select(of("did"), "did", "tkey", "packed").join(shares, "block")
    given = given.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("part"), F.lit(0).cast("long").alias("kind"), "did", "tkey", "packed")
    work = asked.union(given).repartition("block", "part").sortWithinPartitions("block", "part", "kind", "did", "tkey")
    found = written(work.mapInArrow(_factored(width), f"did long, tkey long, factors {FACTORS}").filter(F.size("factors") > 0), "rlz-found")
    released(sources, reference, pairs, shares)
    return found


def parsed(docs: DataFrame, width: int = WIDTH, seed: int = SEED, block: int = BLOCK, share: int = SHARE) -> DataFrame:
    """PARSED for each row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    second = F.xxhash64(F.lit("second"), "text").alias("tkey2")
    keys = keyed(docs).select(F.col("doc_id").cast("long"), "did", "tkey", F.coalesce("text", F.lit("")).alias("text"))
    # Documents with one text: the first is parsed, the others are one factor.
    alike = written(keys.select("did", "tkey", second).groupBy("tkey", "tkey2").agg(F.min("did").alias("first"), F.max("did").alias("last")), "rlz-texts")
    firsts = alike.select(F.col("first").alias("did"), "tkey")
    parts = _candidates(keys, firsts.distinct(), width, seed)
    several = firsts.groupBy("did").agg(F.min("tkey").alias("lo"), F.max("tkey").alias("hi")).filter("lo <> hi").select("did")
    found = _by_blocks(parts, several, width, block, share)
    every = found.groupBy("did", "tkey").agg(F.flatten(F.collect_list("factors")).alias("factors"))
    left = parts.select("did", "tkey", "packed", "own").join(every.hint("shuffle_hash"), ["did", "tkey"], "left").filter("own or factors is not null")
    factored = written(left.mapInArrow(_kept(width), f"did long, tkey long, removed long, sha string, factors {FACTORS}"), "rlz-factors")
    factored = factored.groupBy("did", "tkey").agg(*[F.first(c).alias(c) for c in ("removed", "sha", "factors")])  # of rows that repeat
    released(parts, found)
    plain = keys.select("doc_id", "did", "tkey", second, "text").mapInArrow(_plain, "doc_id long, did long, tkey long, tkey2 long, n_words long, whole string")
    copies = alike.filter("first <> last").select("tkey", "tkey2", "first")
    copies = written(copies, "rlz-copies")
    released(alike)
    rows = plain.join(factored.hint("shuffle_hash"), ["did", "tkey"], "left").join(copies, ["tkey", "tkey2"], "left")
    copy = (F.col("first") < F.col("did")) & (F.col("n_words") >= width)
    one = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("len"), F.col("first").alias("source"), F.lit(0).alias("source_start")))
    none = F.array().cast(FACTORS)
    return rows.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"),
        F.when(copy, one).otherwise(F.coalesce("factors", none)).alias("factors"),
    )


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM d),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM s),
f AS (SELECT k, min({'d': doc_id, 'i': i}) AS src FROM k GROUP BY k HAVING count(*) > 1),
dup AS (SELECT doc_id, list(i) AS starts FROM k JOIN f USING (k) WHERE src <> {'d': doc_id, 'i': i} GROUP BY doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda x: range(x, x + 20)))) AS g FROM dup),
words AS (SELECT doc_id, u.i AS i, u.x AS x FROM (SELECT doc_id, unnest(list_transform(w, lambda x, i: {'i': i, 'x': x})) AS u FROM d)),
out AS (SELECT doc_id, unnest(g) AS i FROM gone),
kept AS (SELECT w.doc_id, string_agg(x, ' ' ORDER BY w.i) AS t, count(*) AS n FROM words w ANTI JOIN out o ON o.doc_id = w.doc_id AND o.i = w.i GROUP BY w.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
