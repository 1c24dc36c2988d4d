"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import alignment, decontaminate, divergence, exact_dedup, html_extract, language_id, packing, personal, quality, secrets, simhash, suffix_dedup, toxicity

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_html_extraction": html_extract.op2_html_extraction,
    "op3_packing": packing.op3_packing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_language_id": language_id.op7_language_id,
    "op8_secrets": secrets.op8_secrets,
    "op9_simhash": simhash.op9_simhash,
    "op10_quality": quality.op10_quality,
    "op11_personal_data": personal.op11_personal_data,
    "op12_divergence": divergence.op12_divergence,
    "op13_alignment": alignment.op13_alignment,
}
SQL = {"op5_decontaminate": decontaminate.SQL, "op6_exact_dedup": exact_dedup.SQL, "op12_divergence": divergence.SQL}
