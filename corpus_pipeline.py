"""The corpus pipeline; its stages are in the subpackage of the training-data operators."""

from litflow.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
