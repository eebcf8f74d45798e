"""The subpackage's queries and their SQL, as __spark_entry__.py adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wordweave.llm.byte_bpe import op8_byte_bpe
from wordweave.llm.chat_format import OP5_SQL, op5_chat_format
from wordweave.llm.language_id import op4_language_id
from wordweave.llm.line_dedup import OP9_SQL, op9_line_dedup
from wordweave.llm.merkle_manifest import OP12_SQL, op12_merkle_manifest
from wordweave.llm.minhash_dedup import OP3_SQL, op3_minhash_dedup
from wordweave.llm.pii_patterns import op7_pii_patterns
from wordweave.llm.quality_rules import op10_quality_rules
from wordweave.llm.source_mix import OP6_SQL, op6_source_mix
from wordweave.llm.spelling_variants import OP13_SQL, op13_spelling_variants
from wordweave.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from wordweave.llm.topk_search import OP2_SQL, op2_topk_search
from wordweave.llm.toxicity import op11_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_topk_search, op3_minhash_dedup, op4_language_id, op5_chat_format, op6_source_mix, op7_pii_patterns, op8_byte_bpe, op9_line_dedup, op10_quality_rules, op11_toxicity, op12_merkle_manifest, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op2_topk_search": OP2_SQL, "op3_minhash_dedup": OP3_SQL, "op5_chat_format": OP5_SQL, "op6_source_mix": OP6_SQL, "op9_line_dedup": OP9_SQL, "op12_merkle_manifest": OP12_SQL, "op13_spelling_variants": OP13_SQL}
