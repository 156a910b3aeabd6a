"""The operators of this package as queries over the given tables."""

from __future__ import annotations

from claimscope.llm.archives import op7_archives
from claimscope.llm.bounded_ring import op4_bounded_ring
from claimscope.llm.byte_index import op2_byte_index
from claimscope.llm.char_tagger import op9_char_tagger
from claimscope.llm.direct_codes import op10_direct_codes
from claimscope.llm.length_buckets import ORACLE_SQL as LENGTH_BUCKETS_SQL
from claimscope.llm.length_buckets import op12_length_buckets
from claimscope.llm.licence_scan import op11_licence_scan
from claimscope.llm.main_text import op3_main_text
from claimscope.llm.piece_codec import op6_piece_codec
from claimscope.llm.prefix_trie import ORACLE_SQL as PREFIX_TRIE_SQL
from claimscope.llm.prefix_trie import op13_prefix_trie
from claimscope.llm.reply_trees import op5_reply_trees
from claimscope.llm.risk_rules import ORACLE_SQL as RISK_RULES_SQL
from claimscope.llm.risk_rules import op8_risk_rules
from claimscope.llm.seed_align import op1_seed_align

QUERIES = {
    "op1_seed_align": op1_seed_align,
    "op2_byte_index": op2_byte_index,
    "op3_main_text": op3_main_text,
    "op4_bounded_ring": op4_bounded_ring,
    "op5_reply_trees": op5_reply_trees,
    "op6_piece_codec": op6_piece_codec,
    "op7_archives": op7_archives,
    "op8_risk_rules": op8_risk_rules,
    "op9_char_tagger": op9_char_tagger,
    "op10_direct_codes": op10_direct_codes,
    "op11_licence_scan": op11_licence_scan,
    "op12_length_buckets": op12_length_buckets,
    "op13_prefix_trie": op13_prefix_trie,
}

# The others have no SQL: hashes, tokenizers, HTML, archives, trained networks. tests/llm holds them against brute force.
ORACLE = {
    "op8_risk_rules": RISK_RULES_SQL,
    "op12_length_buckets": LENGTH_BUCKETS_SQL,
    "op13_prefix_trie": PREFIX_TRIE_SQL,
}
