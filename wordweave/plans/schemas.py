"""Explicit schemas of the engine's tables, as DDL, and upgrades of older ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordweave.functions.text import script

NODE = "id long, key string, word string, canonical string, first_seen timestamp_ntz, lang string, ok boolean"
SURFACE = "node_id long, text string"
GRAPH_CONFIG = "id long, gen_model string, temperature double, extract_model string, k int, prompt_version string, seed int"
RESPONSE = "id long, node_id long, gen_model string, temperature double, prompt_version string, call_id long, text string, created_at timestamp_ntz"
EDGE = "config_id long, src_id long, dst_id long, rank int, response_id long, created_at timestamp_ntz"
NONEDGE = "config_id long, src_id long, dst_id long, source string, created_at timestamp_ntz"
RUN = "id long, config_id long, start_word string, target_word string, mode string, policy string, budget int, max_depth int, seed int, basin_depth int, found boolean, hops int, path array<string>, expanded int, verify_cost int, basin_nodes int, seconds double, created_at timestamp_ntz"
SEARCH_LOG = "id long, kind string, a string, b string, status string, hops int, lang string, created_at timestamp_ntz"
RECORD = "norm_a string, norm_b string, a string, b string, hops int, path array<string>, finder string, created_at timestamp_ntz"
LLM_CALL = "id long, kind string, cache_key string, model string, temperature double, params string, input string, output string, created_at timestamp_ntz"
EMBEDDING = "model string, text string, dim int, vec array<float>, created_at timestamp_ntz"

#: The columns that tell rows of a table apart.
KEYS = {
    "node": ["key"],
    "surface": ["node_id", "text"],
    "graph_config": ["gen_model", "extract_model", "k", "prompt_version", "seed"],
    "response": ["node_id", "gen_model", "temperature", "prompt_version"],
    "edge": ["config_id", "src_id", "dst_id"],
    "nonedge": ["config_id", "src_id", "dst_id"],
    "record": ["norm_a", "norm_b"],
    "llm_call": ["kind", "cache_key"],
    "embedding": ["model", "text"],
}


def conformed(df: DataFrame, schema: str) -> DataFrame:
    """df with the schema's columns in order: missing ones null, others cast."""
    have = set(df.columns)
    fields = [x.split(" ") for x in schema.split(", ")]
    return df.select(*[(F.col(name) if name in have else F.lit(None)).cast(kind).alias(name) for name, kind in fields])


def upgraded_nodes(df: DataFrame) -> DataFrame:
    """Nodes of any version: `lang` is filled from the script where it is null, `ok` stays unknown."""
    return conformed(df, NODE).withColumn("lang", F.coalesce("lang", script(F.col("word"))))


def upgraded_configs(df: DataFrame) -> DataFrame:
    """Configs of any version: those before seeds were kept have seed -1."""
    return conformed(df, GRAPH_CONFIG).withColumn("seed", F.coalesce("seed", F.lit(-1)))


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    ids = nodes.select(F.col("id").alias("node"))
    return edges.join(ids.withColumnRenamed("node", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("node", "dst_id"), "dst_id", "left_semi").select(edges.columns)
