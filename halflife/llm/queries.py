"""The subpackage's queries and their SQL, for __spark_entry__."""

from __future__ import annotations

from halflife.llm import decontam, jaccard, licenses, lines, lmscore, mixing, quality, repeats, tokens, warc

QUERIES = {
    "op1_lm_score": lmscore.op1_lm_score,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_suffix_dedup": repeats.op3_suffix_dedup,
    "op4_jaccard_join": jaccard.op4_jaccard_join,
    "op5_arc_to_warc": warc.op5_arc_to_warc,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_decontaminate": decontam.op7_decontaminate,
    "op8_token_counts": tokens.op8_token_counts,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_line_dedup": lines.op10_line_dedup,
    "lm_base": lmscore.lm_base,
    "mix_targets": mixing.mix_targets,
    "quality_counts": quality.quality_counts,
}

#: DuckDB SQL where SQL can express the query; the others have brute-force tests.
ORACLE_SQL = {
    "lm_base": lmscore.BASE,
    "mix_targets": mixing.TARGETS,
    "op3_suffix_dedup": repeats.ORACLE,
    "op4_jaccard_join": jaccard.ORACLE,
    "quality_counts": quality.COUNTED,
    "op2_license_scan": licenses.ORACLE,
    "op5_arc_to_warc": warc.ORACLE,
    "op10_line_dedup": lines.ORACLE,
}
