"""The queries of the training-data operators and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeleaf.llm.chat import op4_chat_format
from lodeleaf.llm.decontam import op13_benchmark_overlap
from lodeleaf.llm.hardneg import op11_focus_coordinates
from lodeleaf.llm.linedup import op9_line_spread
from lodeleaf.llm.lm import op2_attention_lm
from lodeleaf.llm.mixing import op10_mix_sources
from lodeleaf.llm.ngram_join import op3_ngram_jaccard
from lodeleaf.llm.ogg import op6_ogg_media
from lodeleaf.llm.oracles import ORACLE_SQL
from lodeleaf.llm.packing import op5_best_fit
from lodeleaf.llm.quality import op7_quality_rules
from lodeleaf.llm.sharding import op1_hash_tree_shards
from lodeleaf.llm.trie import op12_prefix_rollup
from lodeleaf.llm.warc import op8_warc_chain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hash_tree_shards": op1_hash_tree_shards,
    "op2_attention_lm": op2_attention_lm,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_chat_format": op4_chat_format,
    "op5_best_fit": op5_best_fit,
    "op6_ogg_media": op6_ogg_media,
    "op7_quality_rules": op7_quality_rules,
    "op8_warc_chain": op8_warc_chain,
    "op9_line_spread": op9_line_spread,
    "op10_mix_sources": op10_mix_sources,
    "op11_focus_coordinates": op11_focus_coordinates,
    "op12_prefix_rollup": op12_prefix_rollup,
    "op13_benchmark_overlap": op13_benchmark_overlap,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
