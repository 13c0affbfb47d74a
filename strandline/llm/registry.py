"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from strandline.llm import clusters, covers, html, leaks, licenses, packing, ppm, quality, secrets, setsketch, shards, suffixes


def queries() -> dict:
    return {
        "op1_license_scan": licenses.query,
        "op2_ppm_scores": ppm.query,
        "op3_token_id_index": shards.query,
        "op4_benchmark_leaks": leaks.query,
        "op5_html_text": html.query,
        "op6_secret_crf": secrets.query,
        "op7_suffix_dedup": suffixes.query,
        "op8_mixture_packing": packing.query,
        "op9_setsketch_near_dedup": setsketch.query,
        "op10_quality_rules": quality.query,
        "op11_gemm_clusters": clusters.query,
        "op12_difference_cover_dedup": covers.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_suffix_dedup": suffixes.ORACLE, "op9_setsketch_near_dedup": setsketch.ORACLE, "op10_quality_rules": quality.ORACLE, "op11_gemm_clusters": clusters.ORACLE, "op12_difference_cover_dedup": covers.ORACLE}
