"""The queries of this subpackage and their SQL, for the entry module."""

from . import chat, cross_tokens, decontaminate, licenses, line_dedup, media, mixing, ngram_join, periodic_runs, quality, substring_dedup, suffix_dedup, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_quality_classifier,
        mixing.op2_mix_sources,
        chat.op3_chat_perspectives,
        toxicity.op4_toxicity,
        media.op5_media_columns,
        substring_dedup.op6_substring_dedup,
        ngram_join.op7_ngram_jaccard_join,
        decontaminate.op8_decontaminate,
        line_dedup.op9_line_dedup,
        licenses.op10_license_scan,
        periodic_runs.op11_periodic_runs,
        cross_tokens.op12_cross_tokens,
        suffix_dedup.op13_suffix_array_dedup,
    )
}
ORACLE_SQL = {
    "op3_chat_perspectives": chat.ORACLE_OP3,
    "op6_substring_dedup": substring_dedup.ORACLE_OP6,
    "op8_decontaminate": decontaminate.ORACLE_OP8,
    "op9_line_dedup": line_dedup.ORACLE_OP9,
    "op10_license_scan": licenses.op10_oracle(),
}
