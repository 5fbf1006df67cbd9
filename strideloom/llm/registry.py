"""Queries and SQL of this package."""

from __future__ import annotations

from strideloom.llm.bag_minhash import op10_bag_minhash
from strideloom.llm.conversation_repair import op12_conversation_repair
from strideloom.llm.filter_audit import OP11_SQL, op11_filter_audit
from strideloom.llm.hilbert_shards import op3_hilbert_shards
from strideloom.llm.language_crf import op6_language_crf
from strideloom.llm.license_scan import op8_license_digests, op8_sql
from strideloom.llm.line_dedup import OP7_SQL, op7_line_dedup
from strideloom.llm.mixing import OP4_SQL, op4_source_mix
from strideloom.llm.permutation_index import op1_permutation_index
from strideloom.llm.piece_codec import op5_piece_codec
from strideloom.llm.progressive_jpeg import op13_progressive_jpeg
from strideloom.llm.suffix_dedup import op9_suffix_dedup
from strideloom.llm.winnowing import op2_winnowing

QUERIES = {
    "op1_permutation_index": op1_permutation_index,
    "op2_winnowing": op2_winnowing,
    "op3_hilbert_shards": op3_hilbert_shards,
    "op4_source_mix": op4_source_mix,
    "op5_piece_codec": op5_piece_codec,
    "op6_language_crf": op6_language_crf,
    "op7_line_dedup": op7_line_dedup,
    "op8_license_digests": op8_license_digests,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_bag_minhash": op10_bag_minhash,
    "op11_filter_audit": op11_filter_audit,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_progressive_jpeg": op13_progressive_jpeg,
}
SQL = {"op4_source_mix": OP4_SQL, "op7_line_dedup": OP7_SQL, "op8_license_digests": op8_sql(), "op11_filter_audit": OP11_SQL}
