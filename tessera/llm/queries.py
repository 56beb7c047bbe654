"""Queries of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

from tessera.llm.alignment import op11_cross_tokenizer_alignment
from tessera.llm.audio import op6_media_columns
from tessera.llm.impact_index import OP13_SQL, op13_exact_top_k
from tessera.llm.mixing import op7_source_mixing
from tessera.llm.ngram_join import op2_ngram_jaccard_join
from tessera.llm.packing import op5_best_fit_packing
from tessera.llm.page_text import op1_html_extraction
from tessera.llm.pii import op8_pii
from tessera.llm.quality_rules import op10_quality_rules
from tessera.llm.recompression import op4_substring_dedup
from tessera.llm.spelling import op12_spelling_variants
from tessera.llm.token_counts import op3_token_counts
from tessera.llm.url_filter import OP9_SQL, op9_url_filter


def queries() -> dict:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_token_counts": op3_token_counts,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_media_columns": op6_media_columns,
        "op7_source_mixing": op7_source_mixing,
        "op8_pii": op8_pii,
        "op9_url_filter": op9_url_filter,
        "op10_quality_rules": op10_quality_rules,
        "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_exact_top_k": op13_exact_top_k,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_url_filter": OP9_SQL, "op13_exact_top_k": OP13_SQL}
