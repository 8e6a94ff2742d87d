"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.llm.conversation_trie import OP12_SQL, op12_conversation_trie
from vellum.llm.decontaminate import OP7_SQL, op7_benchmark_decontamination
from vellum.llm.filter_audit import OP11_SQL, op11_filter_audit
from vellum.llm.jaccard import op10_ngram_jaccard
from vellum.llm.language import op8_language_id
from vellum.llm.lm_scoring import op13_lm_scoring
from vellum.llm.mixing import OP6_SQL, op6_source_mixing
from vellum.llm.pii import op1_pii
from vellum.llm.quality import op2_quality_rules
from vellum.llm.secrets import op3_secret_scan
from vellum.llm.substrings import op9_repeated_substrings
from vellum.llm.token_counts import op5_token_counts
from vellum.llm.url_filter import OP4_SQL, op4_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_quality_rules": op2_quality_rules,
    "op3_secret_scan": op3_secret_scan,
    "op4_url_filters": op4_url_filters,
    "op5_token_counts": op5_token_counts,
    "op6_source_mixing": op6_source_mixing,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_language_id": op8_language_id,
    "op9_repeated_substrings": op9_repeated_substrings,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_filter_audit": op11_filter_audit,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_lm_scoring": op13_lm_scoring,
}

SQL: dict[str, str] = {
    "op4_url_filters": OP4_SQL,
    "op6_source_mixing": OP6_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_conversation_trie": OP12_SQL,
}
