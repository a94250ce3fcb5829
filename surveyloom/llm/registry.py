"""Queries and their SQL, by operator number."""

from __future__ import annotations

from . import decontaminate, license_scan, line_dedup, minhash_dedup, packing, quality_classifier, quality_rules, ranked_search, repeats, spelling, token_files, toxicity, warc

MODULES = [license_scan, line_dedup, quality_rules, minhash_dedup, packing, token_files, quality_classifier, decontaminate, toxicity, repeats, warc, ranked_search, spelling]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
