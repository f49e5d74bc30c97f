"""The queries of this folder and their SQL."""

from .decontaminate import op9_decontaminate
from .line_dedup import OP11_SQL, op11_line_dedup
from .minhash import op5_near_duplicates
from .mixing import op10_mix_sources, op10_sql
from .page_differencing import op7_extract_pages
from .prefix_trie import OP13_SQL, op13_conversation_trie
from .sql import OP1_SQL, OP2_SQL, OP5_SQL
from .spotsigs import op4_spot_fingerprints
from .substring_dedup import op2_substring_dedup
from .suffix_dedup import op1_suffix_dedup
from .suffix_tree_lm import op8_score_texts
from .token_alignment import op12_token_alignment
from .toxicity import op6_toxicity
from .token_counts import OP3_SQL, op3_token_counts, op3_token_counts_bpe


def queries() -> dict:
    found = (op1_suffix_dedup, op2_substring_dedup, op3_token_counts, op3_token_counts_bpe, op4_spot_fingerprints, op5_near_duplicates, op6_toxicity, op7_extract_pages, op8_score_texts, op9_decontaminate, op10_mix_sources, op11_line_dedup, op12_token_alignment, op13_conversation_trie)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op5_near_duplicates": OP5_SQL, "op3_token_counts": OP3_SQL, "op10_mix_sources": op10_sql(), "op11_line_dedup": OP11_SQL, "op13_conversation_trie": OP13_SQL}
