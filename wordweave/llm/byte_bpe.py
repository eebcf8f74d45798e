"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into chunks that run OVERLAP characters into the next one. Each chunk is
pre-tokenised by itself, from its own first character, in parallel. Two neighbours are
stitched at the first place in their overlap where both have a pre-token boundary: the
pattern looks back at nothing, so from there on they agree. Where two neighbours never agree
(one pre-token as long as the overlap), nothing proves the later borders, and the text from
the last proven one to its end is one piece. The pieces are then encoded, each pre-token by
the merge ranks, and their ids put together again in order. Texts of one chunk are encoded
where they are read. Decoding concatenates the raw bytes of ids; it looks at one row at a time.

Results in special cases: null or empty text has no ids and empty decoded bytes; null ids
decode to empty bytes, and ids without a rank fail; rows that repeat give equal rows; rows with
null doc_id are encoded like others; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from wordweave.llm.shared import documents
from wordweave.session import ship

#: Characters of a chunk, and how far it runs into the next one.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Pre-tokens whose ids a worker remembers.
REMEMBERED = 200_000
#: Ids that are decoded at once.
DECODED = 1 << 18
RESULT = "doc_id long, ids array<int>"


def ranks_of(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Coder:
    """Encodes pre-tokens with the ranks of a tiktoken file."""

    def __init__(self, ranks_path: str, pattern: str):
        self.pattern = regex.compile(pattern)
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(ranks_path), special_tokens={})
        self.known: dict[str, tuple[int, ...]] = {}

    def boundaries(self, text: str, start: int = 0) -> Iterator[int]:
        for m in self.pattern.finditer(text, start):
            yield m.end()

    def piece(self, pre_token: str) -> tuple[int, ...]:
        if (ids := self.known.get(pre_token)) is None:
            ids = tuple(self.core._encode_single_piece(pre_token.encode()))
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if len(pre_token) <= 64:
                self.known[pre_token] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of a text that starts and ends at pre-token boundaries."""
        ids: list[int] = []
        known = self.known
        for pre_token in self.pattern.findall(text):
            ids += known.get(pre_token) or self.piece(pre_token)
        return ids


@lru_cache(maxsize=2)
def coder(ranks_path: str, pattern: str) -> Coder:
    """One for each Python worker."""
    return Coder(ranks_path, pattern)


@lru_cache(maxsize=2)
def bytes_of(ranks_path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all ids one after another, where each id's begin, and their number, -1 without a rank; one for each Python worker."""
    ranks = ranks_of(ranks_path)
    size = np.full(max(ranks.values(), default=-1) + 1, -1)
    start, data = np.zeros(len(size), np.int64), bytearray()
    for b, i in ranks.items():
        start[i], size[i] = len(data), len(b)
        data += b
    return np.frombuffer(bytes(data), np.uint8), start, size


def _lists(rows: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.fromiter(chain.from_iterable(rows), np.int32, ends[-1])))


def _encoded(ranks_path: str, pattern: str, keys: int):
    """(keys.., text) to (keys.., ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks_path, pattern)
        for batch in batches:
            ids = _lists([c.encode(text) for text in batch.column(keys).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(keys)), ids], names=[*batch.schema.names[:keys], "ids"])

    return run


def _decoded(ranks_path: str):
    """(.., ids) to (.., ids, raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, start, size = bytes_of(ranks_path)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            ids = lists.flatten().to_numpy()
            if len(ids) and (ids.min() < 0 or ids.max() >= len(size) or size[ids].min() < 0):
                raise ValueError("ids without a rank")
            ends = np.concatenate([[0], np.cumsum(size[ids])])
            raw = np.empty(ends[-1], np.uint8)
            for lo in range(0, len(ids), DECODED):
                part = ids[lo : lo + DECODED]
                begin, end = ends[lo], ends[lo + len(part)]
                shift = start[part] - (ends[lo : lo + len(part)] - begin)
                raw[begin:end] = data[np.repeat(shift, size[part]) + np.arange(end - begin)]
            number = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            offsets = ends[np.concatenate([[0], np.cumsum(number)])].astype(np.int32)
            rows = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], names=[*batch.schema.names, "raw"])

    return run


def _borders(ranks_path: str, pattern: str, overlap: int):
    """For each chunk (key, at, body, rest): the place of its first boundary, counted in the whole text, that the next chunk has as well; null if there is none.

    body is the chunk up to the next one's start, rest the overlap; the next chunk's boundaries in the overlap follow from rest alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks_path, pattern)
        for batch in batches:
            met = []
            for at, body, rest in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                text, start = body + rest, len(body)
                last = len(text) if len(rest) < overlap else len(text) - 1  # a match that ends with the text may be cut short
                own = {p for p in c.boundaries(text) if start <= p <= last}
                found = next((p + start for p in c.boundaries(rest) if p + start in own and p + start <= last), None) if rest else None
                met.append(None if found is None or (len(rest) < overlap and found >= len(text)) else at + found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(met, pa.int64())], names=["did", "tkey", "at", "met"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """RESULT for each row of docs (doc_id, text). Only texts of more than a chunk are shuffled, as chunks; a document's ids meet again in its row."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    both = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    short = both.filter(F.length("text") <= chunk).mapInArrow(_encoded(ranks_path, pattern, 1), RESULT)
    long = both.filter(F.length("text") > chunk).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("did"), F.xxhash64("text").alias("tkey"), "doc_id", "text")
    cut = long.dropDuplicates(["did", "tkey"])
    starts = cut.select("did", "tkey", "text", F.length("text").alias("chars"), F.explode(F.sequence(F.lit(0).cast("long"), F.length("text").cast("long") - 1, F.lit(chunk).cast("long"))).alias("at"))
    chunks = starts.select(
        "did", "tkey", "at", F.substring("text", F.col("at").cast("int") + 1, F.lit(chunk)).alias("body"), F.substring("text", F.col("at").cast("int") + chunk + 1, F.lit(overlap)).alias("rest")
    ).repartition("did", "tkey", "at")
    met = chunks.mapInArrow(_borders(ranks_path, pattern, overlap), "did long, tkey long, at long, met long")
    borders = met.groupBy("did", "tkey").agg(F.array_sort(F.collect_list(F.struct("at", "met"))).alias("b"))
    agreed = (F.array_position(F.transform("b", lambda x: x["met"].isNull()), True) - 1).cast("int")  # the last chunk has no next one
    cuts = borders.select("did", "tkey", F.concat(F.array(F.lit(0).cast("long")), F.transform(F.slice("b", F.lit(1), agreed), lambda x: x["met"])).alias("cuts"))
    ends = F.transform("cuts", lambda x, i: F.struct(x.alias("start"), F.coalesce(F.try_element_at("cuts", (i + 2).cast("int")), F.length("text").cast("long")).alias("end")))
    pieces = cut.join(cuts, ["did", "tkey"]).select("did", "tkey", "text", F.explode(ends).alias("p")).select("did", "tkey", F.col("p.start").alias("at"), F.substring("text", (F.col("p.start") + 1).cast("int"), (F.col("p.end") - F.col("p.start")).cast("int")).alias("text")).filter("text <> ''")
    done = pieces.repartition("did", "tkey", "at").mapInArrow(_encoded(ranks_path, pattern, 3), "did long, tkey long, at long, ids array<int>")
    whole = done.groupBy("did", "tkey").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    whole = whole.select("did", "tkey", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))
    return short.unionByName(long.select("did", "tkey", "doc_id").join(whole, ["did", "tkey"]).select("doc_id", "ids"))


def decode(rows: DataFrame, ranks_path: str) -> DataFrame:
    """rows (.., ids) with `raw`, the bytes that the ids stand for."""
    ship(rows.sparkSession)
    rows = rows.select(*[c for c in rows.columns if c != "ids"], F.col("ids").cast("array<int>"))
    return rows.mapInArrow(_decoded(ranks_path), StructType([*rows.schema.fields, StructField("raw", BinaryType())]))


def digested(rows: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of rows (doc_id, ids, raw)."""
    said = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said, 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))


def public_ranks() -> tuple[str, str]:
    """Path and pattern of the vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_ranks()
    return digested(decode(encode(documents(spark, sf_dir), ranks, pattern), ranks))
