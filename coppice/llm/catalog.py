"""The text-pipeline queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from coppice.llm import convrepair, decontam, exactdedup, htmltext, infill, langid, linededup, packing, quality, simhash, tokencount, tokenfiles, urlfilter

QUERIES = {
    "op1_token_files": tokenfiles.op1_token_files,
    "op2_url_filter": urlfilter.op2_url_filter,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_benchmark_decontamination": decontam.op4_benchmark_decontamination,
    "op5_language_id": langid.op5_language_id,
    "op6_html_extraction": htmltext.op6_html_extraction,
    "op7_packing": packing.op7_packing,
    "op8_token_counts": tokencount.op8_token_counts,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_exact_dedup": exactdedup.op11_exact_dedup,
    "op12_fill_in_middle": infill.op12_fill_in_middle,
    "op13_conversation_repair": convrepair.op13_conversation_repair,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": linededup.OP3_SQL,
    "op4_benchmark_decontamination": decontam.OP4_SQL,
    "op9_quality_rules": quality.OP9_SQL,
    "op11_exact_dedup": exactdedup.OP11_SQL,
    "op12_fill_in_middle": infill.OP12_SQL,
    "op13_conversation_repair": convrepair.OP13_SQL,
}
