"""The corpus pipeline: STAGES, ORACLE_SQL and run() of gridloom.llm.pipeline."""

from gridloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
