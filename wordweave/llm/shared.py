"""What the operators of this subpackage share: word rules, keys and written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordweave.session import shared_dir, written
from wordweave.sources.readers import table

__all__ = ["NULL_ID", "WORD", "documents", "keyed", "n_words", "shared_dir", "written"]

#: A word is a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id wherever rows have to be joined.
NULL_ID = -(2**63)


def n_words(text: Column) -> Column:
    """Number of words of a text as a long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """docs as (doc_id, text, did, tkey) alone. (did, tkey) tells documents apart: doc_id with nulls as NULL_ID, and a hash of the text.

    Rows that agree in both are one document, and each of them gets that document's result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).cast("long").alias("did"), F.xxhash64(text).alias("tkey"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")
