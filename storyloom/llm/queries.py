"""The queries of this subpackage, by name, and their SQL where DuckDB can express them."""

from __future__ import annotations

from .ann import op7_nearest_vectors
from .chat import OP1_SQL, op1_format_chat
from .langid import op10_identify_language
from .mixing import op5_mix_sources
from .neardup import op4_near_duplicates
from .packing import op2_pack_documents
from .quality import op6_quality_rules
from .rulefit import op13_classify_quality
from .scoring import op3_score_documents
from .sharding import op9_shard_documents
from .toxicity import op8_score_toxicity
from .treaps import OP11_SQL, op11_ranked_search
from .trie import OP12_SQL, op12_prefix_trie


def queries() -> dict:
    found = (op1_format_chat, op2_pack_documents, op3_score_documents, op4_near_duplicates, op5_mix_sources, op6_quality_rules, op7_nearest_vectors, op8_score_toxicity, op9_shard_documents, op10_identify_language, op11_ranked_search, op12_prefix_trie, op13_classify_quality)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_format_chat": OP1_SQL, "op11_ranked_search": OP11_SQL, "op12_prefix_trie": OP12_SQL}
