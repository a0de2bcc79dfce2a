"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from lexmesh.llm import decontam, html, linededup, lm, mixing, quality, simhash, suffixdedup, tokencount, tokenfile
from lexmesh.llm.common import table


def _documents(operator):
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": _documents(quality.quality_rules),
    "op2_simhash_near_dedup": _documents(simhash.near_duplicates),
    "op3_token_id_output": _documents(tokenfile.token_digest),
    "op4_suffix_array_dedup": _documents(suffixdedup.remove_repeats),
    "op5_line_dedup": _documents(linededup.dedup_report),
    "op6_lm_scoring": _documents(lm.score_documents),
    "op7_html_extraction": lambda spark, sf_dir: html.extract(table(spark, sf_dir, "pages")),
    "op8_benchmark_decontamination": lambda spark, sf_dir: decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op9_token_counts": _documents(tokencount.token_counts),
    "op10_source_mixing": _documents(mixing.mix_report),
}

ORACLE_SQL = {
    "op1_quality_rules": quality.ORACLE,
    "op8_benchmark_decontamination": decontam.ORACLE,
    "op10_source_mixing": mixing.ORACLE,
}
