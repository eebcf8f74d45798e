"""From raw documents to token ids: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. run() writes each stage's result as Parquet in the shared folder and
reads it again as the next stage's docs.

Results in special cases: null and empty texts have no words, so the first stage drops them;
by themselves, line dedup and near-dedup keep them as they are, the mix drops what takes no
place in it, and encoding gives them no ids. A null doc_id is a document like others, smaller
than any other. Rows that agree in doc_id and text are one document: lines and near copies are
judged once for all of them, each stays or goes with the others, and the mix takes each row as
often as its own place says. Of copies the least doc_id stays, of repeated lines those in the
greatest. Texts of any length are judged, hashed and encoded whole. A null source is a source
of its own; a document without a label weighs 1. More columns pass through whatever their
names, but for the last stage, which returns doc_id and digests alone. An empty table passes as
an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordweave.llm.byte_bpe import decode, digested, encode, public_ranks
from wordweave.llm.line_dedup import dedup_lines
from wordweave.llm.minhash_dedup import near_deduplicated
from wordweave.llm.quality_rules import accepted
from wordweave.llm.shared import documents, written
from wordweave.llm.source_mix import mixed


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many documents stay in the last of them only; n_chars follows the text, but for a null one."""
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns) if "n_chars" in docs.columns else out


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: sets of five-word shingles, similarity 0.8 or more."""
    return near_deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; good ones by labels are likelier."""
    return mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the bytes they decode to, as digests."""
    ranks, pattern = public_ranks()
    return digested(decode(encode(docs, ranks, pattern), ranks))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("minhash_near_dedup", minhash_near_dedup), ("source_mix", source_mix), ("byte_bpe", byte_bpe)]

#: SQL has no zstandard and no merge ranks; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
