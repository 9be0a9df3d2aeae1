"""Corpus pipeline: the stages of ``emulsa.llm.pipeline`` under the name that the driver imports."""

from emulsa.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
