"""The training-data queries and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, exact_dedup, html_extract, language, line_dedup, negatives, packing, scoring, simhash, substring_dedup, toxicity, warc, whitening


def queries() -> dict:
    return {
        "op1_packing": packing.op1_packing,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_simhash": simhash.op3_simhash,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_html": html_extract.op5_html,
        "op6_warc": warc.op6_warc,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_language": language.op10_language,
        "op11_whitening": whitening.op11_whitening,
        "op12_scoring": scoring.op12_scoring,
        "op13_hard_negatives": negatives.op13_hard_negatives,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": exact_dedup.OP4_SQL, "op6_warc": warc.OP6_SQL, "op13_hard_negatives": negatives.OP13_SQL}
