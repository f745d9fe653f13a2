"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm.bpe import op10_bpe
from tessera.llm.decontaminate import op2_decontaminate
from tessera.llm.pii import op3_pii
from tessera.llm.quality_fm import op9_quality
from tessera.llm.quality_rules import OP7_SQL, op7_quality_rules
from tessera.llm.sharding import op5_sharding
from tessera.llm.simhash import op1_simhash
from tessera.llm.substring_dedup import OP6_SQL, op6_substring_dedup
from tessera.llm.suffix_dedup import OP8_SQL, op8_suffix_dedup
from tessera.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_decontaminate": op2_decontaminate,
    "op3_pii": op3_pii,
    "op4_toxicity": op4_toxicity,
    "op5_sharding": op5_sharding,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality": op9_quality,
    "op10_bpe": op10_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op6_substring_dedup": OP6_SQL,
    "op7_quality_rules": OP7_SQL,
    "op8_suffix_dedup": OP8_SQL,
}
