"""A training corpus from a table of documents: the stages of `panelmill.llm.pipeline`, for the command line and checks."""

from panelmill.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
