"""Quality rules by compression bands.

Zstandard's ratio of a whole document, and of its fixed chunks, says how repetitive it is. A
document outside the band of its length is rejected: above it, the text repeats itself; below
it, the text is noise that does not compress. Every byte of a text of 1 KB and more lies in a
judged chunk: the last one ends with the text, and a text of up to a chunk is one. A few
counting rules come first.

Results in special cases: null or empty text has no word, so it fails the base rule; a
document of any length is judged whole; rows that repeat are judged alike, row by row; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordweave.llm.shared import documents
from wordweave.llm.wordhash import SPACE, Words, mix, slices
from wordweave.session import ship

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, low_chunks long, high_chunks long, n_chunks long"


@dataclass(frozen=True)
class Bands:
    """Ratios are raw bytes by compressed bytes. Documents of at least so many bytes have to lie in [low, high].

    Prose of 1 KB and more compresses 1.7 to 3.5 times; texts under 256 bytes cannot be told
    apart by what they compress to, so they have no band. A lower limit lies above random base64
    in words of 8 characters and below prose (the least of sf0.1's documents). By bytes, noise
    and prose: 256-399 up to 1.18, from 1.34; 400-639 1.25, 1.41; 640-1023 1.30, 1.47; 1024-4095
    1.35, 1.69; 4096 and more 1.36, 2.09.
    """

    level: int = 3
    whole: tuple[tuple[int, float, float], ...] = ((0, 0.0, float("inf")), (256, 1.22, 4.5), (400, 1.3, 4.5), (640, 1.35, 4.5), (1024, 1.4, 5.0), (4096, 1.4, 7.0), (16384, 1.4, 9.0))
    chunk: int = 4096
    chunk_band: tuple[float, float] = (1.35, 9.0)
    #: Shorter texts are judged whole only.
    least_chunk: int = 1024
    #: The share of a document's bytes whose chunks may lie outside. The last chunk counts for the bytes that no other has.
    chunk_share: float = 0.25


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeat_words(w: Words) -> np.ndarray:
    """For each document, words that lie in a 3-word window found twice or more in it."""
    hashes, ok = w.shingles(3)
    at = np.flatnonzero(ok)
    doc = w.doc_of_word()
    key = mix(hashes[at] ^ mix(doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    covered = np.zeros(len(hashes) + 2, bool)
    for step in range(3):
        covered[at[twice] + step] = True
    return np.bincount(doc[covered[: len(hashes)]], minlength=w.n)


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def judge(bands: Bands):
    """A function over Arrow batches of (doc_id, text) that returns batches of SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)
        edges = np.array([x[0] for x in bands.whole])
        low, high = bands.chunk_band
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for w in slices(texts):
                sums = lambda flags, w=w: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[w.offsets])
                n = np.diff(w.first)
                chars = sums(~SPACE[w.data] & ((w.data & 0xC0) != 0x80))
                symbols, repeats = sums(_SYMBOL[w.data]), _repeat_words(w)
                dup, ratio, below, above, chunks, outside = (np.zeros(w.n, t) for t in (np.int64, float, np.int64, np.int64, np.int64, np.int64))
                raw = memoryview(w.data)
                for i in range(w.n):
                    text = bytes(raw[w.offsets[i] : w.offsets[i + 1]])
                    dup[i] = _dup_lines(text)
                    ratio[i] = len(text) / len(packer.compress(text))
                    if len(text) >= bands.least_chunk:
                        for at in range(0, len(text), bands.chunk):
                            own = min(bands.chunk, len(text) - at)
                            part = text[max(0, at + own - bands.chunk) : at + own]
                            r = len(part) / len(packer.compress(part)) if len(part) < len(text) else ratio[i]
                            chunks[i] += 1
                            below[i] += r < low
                            above[i] += r > high
                            outside[i] += own * (r < low or r > high)
                band = np.array(bands.whole)[np.searchsorted(edges, np.diff(w.offsets), "right") - 1]
                failed = (n < 50) | (100 * repeats > 50 * n)
                good = (ratio >= band[:, 1]) & (ratio <= band[:, 2]) & (outside <= bands.chunk_share * np.diff(w.offsets))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(w.lo, w.n).cast(pa.int64()), *(pa.array(x.astype(np.int64)) for x in (n, chars, symbols, dup, repeats)), pa.array(failed), pa.array(~failed & good), pa.array(ratio), *(pa.array(x) for x in (below, above, chunks))],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )

    return run


def compression_bands(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row of SCHEMA for each row of docs (doc_id, text). No shuffle: every document is judged where it is read."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(judge(bands), SCHEMA)


def accepted(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of docs that are kept, all columns as they are, in the same pass over the text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(c)) for c in ("doc_id", "text")], names=["doc_id", "text"])
            if batch.num_rows:
                kept = pa.concat_arrays([x.column(7) for x in judge(bands)(iter([own]))])
                yield batch.filter(kept)

    return docs.mapInArrow(run, docs.schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(documents(spark, sf_dir))
