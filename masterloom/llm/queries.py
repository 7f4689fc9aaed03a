"""The registered queries of this package and their SQL."""

from __future__ import annotations

from .query_chat import OP5_SQL, op5_chat_format
from .query_fingerprints import op2_imatch
from .query_langid import op1_language_id
from .query_minhash import OP8_SQL, op8_minhash_dedup
from .query_mixing import OP4_SQL, op4_mix_sources
from .query_pieces import op3_sentencepiece
from .query_ranker import op13_quality_ranker
from .query_repair import OP11_SQL, op11_conversation_repair
from .query_spelling import OP12_SQL, op12_spelling_variants
from .query_substrings import OP9_SQL, op9_substring_dedup
from .query_suffix_tree import op7_suffix_tree
from .query_urls import op10_url_trust
from .query_vectors import OP6_SQL, op6_embedding_dedup

QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_imatch, op3_sentencepiece, op4_mix_sources, op5_chat_format, op6_embedding_dedup,
    op7_suffix_tree, op8_minhash_dedup, op9_substring_dedup, op10_url_trust, op11_conversation_repair,
    op12_spelling_variants, op13_quality_ranker)}
ORACLES = {
    "op4_mix_sources": OP4_SQL,
    "op5_chat_format": OP5_SQL,
    "op6_embedding_dedup": OP6_SQL,
    "op8_minhash_dedup": OP8_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
}
