"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from larder.llm.chat_format import OP2_SQL, op2_chat_format
from larder.llm.decontaminate import op4_decontaminate
from larder.llm.embedding_dedup import op8_embedding_dedup
from larder.llm.language import op13_language
from larder.llm.merkle import op11_merkle
from larder.llm.near_dup import op1_near_dup
from larder.llm.oracle import DECONTAMINATE, EMBEDDING_DEDUP, MERKLE, NEAR_DUP, SPELLING, SUBSTRING_DEDUP
from larder.llm.packing import op10_pack
from larder.llm.quality_crf import op3_quality_crf
from larder.llm.sharding import op9_jump_shards
from larder.llm.spelling import op12_spelling
from larder.llm.sstable import op6_token_sstable
from larder.llm.substring_dedup import op5_substring_dedup
from larder.llm.warc import op7_warc_derivatives

QUERIES = {
    "op1_near_dup": op1_near_dup,
    "op2_chat_format": op2_chat_format,
    "op3_quality_crf": op3_quality_crf,
    "op4_decontaminate": op4_decontaminate,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_sstable": op6_token_sstable,
    "op7_warc_derivatives": op7_warc_derivatives,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_jump_shards": op9_jump_shards,
    "op10_pack": op10_pack,
    "op11_merkle": op11_merkle,
    "op12_spelling": op12_spelling,
    "op13_language": op13_language,
}

ORACLE_SQL: dict[str, str] = {
    "op1_near_dup": NEAR_DUP,
    "op2_chat_format": OP2_SQL,
    "op4_decontaminate": DECONTAMINATE,
    "op5_substring_dedup": SUBSTRING_DEDUP,
    "op8_embedding_dedup": EMBEDDING_DEDUP,
    "op11_merkle": MERKLE,
    "op12_spelling": SPELLING,
}
