"""The corpus pipeline: STAGES, ORACLE_SQL and run(spark, sf_dir); see tidewick.llm.pipeline."""

from tidewick.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
