"""The registered queries of the package: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from sparkloom.plans import comparison, composites, corpus, dictionary, evaluation, events, language, matrix, reports, script, store
from sparkloom.plans.fixture import LINES_SQL, by_characters

_MODULES = (evaluation, corpus, script, language, store, reports, events, composites, comparison, dictionary, matrix)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: by_characters(sql) if LINES_SQL in sql else sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
