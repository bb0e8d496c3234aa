"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from ledgerlake.llm import (
    byte_bpe,
    decontamination,
    id_files,
    license_scan,
    line_dedup,
    near_dedup,
    ranked_search,
    secret_scan,
    substring_dedup,
    token_alignment,
    token_counts,
    toxicity,
    vector_search,
)


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_near_dedup": near_dedup.op2_near_dedup,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_byte_bpe": byte_bpe.op4_byte_bpe,
        "op5_decontamination": decontamination.op5_decontamination,
        "op6_secret_scan": secret_scan.op6_secret_scan,
        "op7_license_scan": license_scan.op7_license_scan,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_vector_search": vector_search.op9_vector_search,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op11_ranked_search": ranked_search.op11_ranked_search,
        "op12_id_files": id_files.op12_id_files,
        "op13_token_alignment": token_alignment.op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_secret_scan": secret_scan.OP6_SQL, "op9_vector_search": vector_search.OP9_SQL, "op11_ranked_search": ranked_search.OP11_SQL}
