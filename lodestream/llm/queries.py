"""The queries and SQL of this subpackage, for ``__spark_entry__.py``."""

from __future__ import annotations

from . import bpe, chat_format, exact_dedup, nbsvm, packing, quality_rules, sharding, simhash, suffix_dedup, url_filter


def queries() -> dict:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_nbsvm": nbsvm.op2_nbsvm,
        "op3_packing": packing.op3_packing,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_sharding": sharding.op5_sharding,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_simhash": simhash.op7_simhash,
        "op8_chat_format": chat_format.op8_chat_format,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_chat_format": chat_format.OP8_SQL, "op10_exact_dedup": exact_dedup.OP10_SQL}
