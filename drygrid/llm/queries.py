"""The registered queries of this subpackage: name -> (spark, folder) -> DataFrame, and their SQL where SQL can say it."""

from __future__ import annotations

from drygrid.llm import (
    containment, factorisation, filter_audit, lattice, line_alignment, oracles, packing, recompression, secrets, setsketch, sharding, target_ratio, token_alignment, url_filter,
)

QUERIES = {
    "op1_quality_classifier": factorisation.op1,
    "op2_best_fit_packing": packing.op2,
    "op3_sharding": sharding.op3,
    "op4_secret_scan": secrets.op4,
    "op5_line_dedup": line_alignment.op5,
    "op6_near_duplicates": setsketch.op6,
    "op7_quality_rules": target_ratio.op7,
    "op8_substring_dedup": recompression.op8,
    "op9_decontamination": containment.op9,
    "op10_url_filter": url_filter.op10,
    "op11_lattice_scores": lattice.op11,
    "op12_token_alignment": token_alignment.op12,
    "op13_filter_audit": filter_audit.op13,
}
ORACLE_SQL = oracles.ORACLE_SQL
