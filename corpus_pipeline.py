"""The corpus pipeline: quality rules, line dedup, near-duplicate join, substring dedup, packing (see sparkloom/llm/pipeline.py)."""

from sparkloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
