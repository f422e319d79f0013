"""Corpus pipeline: quality rules, exact and near de-duplication, repeated passages, packing."""

from hourmark.llm.pipeline import ORACLE_SQL, STAGES, good_text, packed, run, without_copies, without_near_copies, without_passages

__all__ = ["ORACLE_SQL", "STAGES", "good_text", "packed", "run", "without_copies", "without_near_copies", "without_passages"]
