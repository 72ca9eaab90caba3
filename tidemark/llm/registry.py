"""Queries of the training-data operators, by name, and the SQL that gives the same rows."""

from __future__ import annotations

import corpus_pipeline

from . import decontamination, language_id, license_scan, line_dedup, packing, quality, secret_scan, simhash, token_counts, url_filter

MODULES = (simhash, decontamination, url_filter, license_scan, quality, line_dedup, token_counts, packing, language_id, secret_scan)


def queries() -> dict:
    out = {k: f for m in MODULES for k, f in m.QUERIES.items()}
    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    out = {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
