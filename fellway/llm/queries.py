"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from . import lexical_search, substring_words, topk_search
from .html_text import op11_html_text
from .language_id import op1_language_id
from .media_columns import op4_media_columns
from .packing import op7_packing
from .periodic_runs import op13_periodic_runs
from .sentencepiece_prefix import op6_sentencepiece
from .sharding import op10_sharding
from .simhash import op3_simhash
from .substring_bytes import op2_substring_bytes
from .token_counts import op5_token_counts

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_substring_bytes": op2_substring_bytes,
    "op3_simhash": op3_simhash,
    "op4_media_columns": op4_media_columns,
    "op5_token_counts": op5_token_counts,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_packing": op7_packing,
    "op8_substring_words": substring_words.op8_substring_words,
    "op9_topk_search": topk_search.op9_topk_search,
    "op10_sharding": op10_sharding,
    "op11_html_text": op11_html_text,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_periodic_runs": op13_periodic_runs,
}

#: DuckDB SQL for the queries that SQL can express over whole tables.
ORACLE_SQL: dict[str, str] = {"op8_substring_words": substring_words.ORACLE, "op9_topk_search": topk_search.ORACLE, "op12_lexical_search": lexical_search.ORACLE}
