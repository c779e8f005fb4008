"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from loomspan.llm import audit, bpe, collocations, decontaminate, lines, quality, runindex, secrets, shards, sketches, substrings, tiff, urls


def queries():
    return {
        "op1_tiff_pages": tiff.op1_tiff_pages,
        "op2_spaced_seeds": decontaminate.op2_spaced_seeds,
        "op3_line_dedup": lines.op3_line_dedup,
        "op4_url_rules": urls.op4_url_rules,
        "op5_bradley_terry": quality.op5_bradley_terry,
        "op6_setsketch_groups": sketches.op6_setsketch_groups,
        "op7_char_cnn": secrets.op7_char_cnn,
        "op8_substring_dedup": substrings.op8_substring_dedup,
        "op9_byte_bpe": bpe.op9_byte_bpe,
        "op10_minimax_shards": shards.op10_minimax_shards,
        "op11_collocations": collocations.op11_collocations,
        "op12_run_index": runindex.op12_run_index,
        "op13_filter_audit": audit.op13_filter_audit,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {
        "op2_spaced_seeds": decontaminate.OP2_SQL,
        "op3_line_dedup": lines.OP3_SQL,
        "op4_url_rules": urls.OP4_SQL,
        "op6_setsketch_groups": sketches.OP6_SQL,
        "op8_substring_dedup": substrings.OP8_SQL,
        "op11_collocations": collocations.OP11_SQL,
        "op12_run_index": runindex.OP12_SQL,
        "op13_filter_audit": audit.OP13_SQL,
    }
