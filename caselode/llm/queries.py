"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from . import ann, collocations, divergence, exact_dedup, katz, line_dedup, packing, quality, sentencepieces, simhash, toxicity, url_filter, warc

QUERIES = {
    "op1_quality_crf": quality.query,
    "op2_toxicity_ftrl": toxicity.query,
    "op3_simhash_near_dedup": simhash.query,
    "op4_line_dedup": line_dedup.passages,
    "op4_line_dedup_passages": line_dedup.passages,
    "op4_line_dedup_runs": line_dedup.query,
    "op5_warc_archive": warc.query,
    "op6_katz_scoring": katz.query,
    "op7_best_fit_packing": packing.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_sentencepiece_nbest": sentencepieces.query,
    "op10_mips_search": ann.query,
    "op11_url_filter": url_filter.query,
    "op12_collocations": collocations.query,
    "op13_source_divergence": divergence.query,
}
ORACLE_SQL = {
    "op4_line_dedup": line_dedup.PASSAGES_SQL,
    "op4_line_dedup_passages": line_dedup.PASSAGES_SQL,
    "op4_line_dedup_runs": line_dedup.ORACLE_SQL,
    "op5_warc_archive": warc.ORACLE_SQL,
    "op8_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_url_filter": url_filter.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
    "op13_source_divergence": divergence.ORACLE_SQL,
}
