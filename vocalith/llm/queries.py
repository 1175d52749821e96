"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from vocalith.llm import (
    decontamination,
    lm_scores,
    periodic_runs,
    prefix_trie,
    quality_rules,
    quote_links,
    secret_scans,
    simhash,
    source_mix,
    substring_dedup,
    suffix_array,
    url_filters,
    warc_convert,
)

_MODULES = (secret_scans, source_mix, lm_scores, decontamination, quote_links, quality_rules, suffix_array, url_filters, substring_dedup, simhash, warc_convert, prefix_trie, periodic_runs)

_ALL = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
QUERIES = {k: f for k, (f, _) in _ALL.items()}
ORACLE_SQL = {k: sql for k, (_, sql) in _ALL.items() if sql}
