"""Queries and SQL of the corpus operators, one opN_<name> each."""

from . import align, audit, chat, decontaminate, jaccard, linededup, lm, mixing, quality, rules, sharding, toxicity, urlfilter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_sharding": sharding.op2_sharding,
    "op3_ngram_jaccard": jaccard.op3_ngram_jaccard,
    "op4_urlfilter": urlfilter.op4_urlfilter,
    "op5_rules": rules.op5_rules,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_lm": lm.op7_lm,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_linededup": linededup.op9_linededup,
    "op10_mixing": mixing.op10_mixing,
    "op11_chat_format": chat.op11_chat_format,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_token_alignment": align.op13_token_alignment,
}
ORACLE_SQL: dict[str, str] = {
    "op2_sharding": sharding.sql(),
    "op3_ngram_jaccard": jaccard.SQL,
    "op4_urlfilter": urlfilter.sql(),
    "op6_decontamination": decontaminate.SQL,
    "op9_linededup": linededup.SQL,
    "op10_mixing": mixing.SQL,
    "op11_chat_format": chat.SQL,
    "op12_filter_audit": audit.SQL,
}
