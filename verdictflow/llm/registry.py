"""The queries of this subpackage, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdictflow.llm.best_fit import op13_best_fit
from verdictflow.llm.html_extract import op10_html_extraction
from verdictflow.llm.jaccard_join import OP6_SQL, op6_jaccard_join
from verdictflow.llm.merkle_manifest import OP11_SQL, op11_merkle_manifest
from verdictflow.llm.piece_tokenizer import op4_sentencepiece
from verdictflow.llm.quality_rules import op8_quality_rules
from verdictflow.llm.secret_scan import op3_secret_scan
from verdictflow.llm.source_mix import OP7_SQL, op7_source_mix
from verdictflow.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from verdictflow.llm.token_counts import op9_token_counts
from verdictflow.llm.top_k import OP5_SQL, op5_top_k
from verdictflow.llm.warc import OP2_SQL, op2_warc
from verdictflow.llm.whitening import op12_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_warc": op2_warc,
    "op3_secret_scan": op3_secret_scan,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_top_k": op5_top_k,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_source_mix": op7_source_mix,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_counts": op9_token_counts,
    "op10_html_extraction": op10_html_extraction,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_whitening": op12_whitening,
    "op13_best_fit": op13_best_fit,
}

ORACLES: dict[str, str] = {"op1_substring_dedup": OP1_SQL, "op2_warc": OP2_SQL, "op5_top_k": OP5_SQL,
                           "op6_jaccard_join": OP6_SQL, "op7_source_mix": OP7_SQL, "op11_merkle_manifest": OP11_SQL}
