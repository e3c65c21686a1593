"""Queries of the corpus operators, and SQL for those that it can express."""

from __future__ import annotations

from . import bpe, lexical, licences, packing, periodic, phrases, quality_rules, quality_votes, repeats, sharding, simhash, topk, url_lists


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_repeats": repeats.op2_repeats,
        "op3_topk": topk.op3_topk,
        "op4_quality_votes": quality_votes.op4_quality_votes,
        "op5_simhash": simhash.op5_simhash,
        "op6_bpe": bpe.op6_bpe,
        "op7_licences": licences.op7_licences,
        "op8_packing": packing.op8_packing,
        "op9_url_lists": url_lists.op9_url_lists,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "op11_lexical": lexical.op11_lexical,
        "op12_phrases": phrases.op12_phrases,
        "op13_periodic": periodic.op13_periodic,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": topk.ORACLE_TOPK, "op9_url_lists": url_lists.ORACLE, "op11_lexical": lexical.ORACLE, "op12_phrases": phrases.ORACLE}
