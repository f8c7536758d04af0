"""The queries of this subpackage and their DuckDB SQL, the corpus pipeline among them."""

from __future__ import annotations

from sparkloom.llm import embedding_caps, fingerprints, jaccard_join, licenses, line_dedup, packing, pieces, pipeline, quality_classifier, quality_rules, snapshot_diff, source_divergence, substring_dedup, toxicity

_MODULES = (substring_dedup, pieces, packing, quality_classifier, toxicity, licenses, jaccard_join, line_dedup, fingerprints, quality_rules, embedding_caps, snapshot_diff, source_divergence)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()} | {"pipeline": pipeline.run}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
if pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = pipeline.ORACLE_SQL
