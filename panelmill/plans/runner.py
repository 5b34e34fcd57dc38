"""Runs named stages one after another and reports what became of each."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

STATUS = "product_id string, model_name string, feature_set string, status string, rows long, seconds double, error string"


@dataclass
class Runner:
    """Writes the table of each stage below `path`; a failing stage is recorded and the next one still runs.

    Rows are counted by an observation on the write itself. There is one outcome per stage, so the
    status table is as small as the list of stages.
    """

    spark: SparkSession
    path: str
    outcomes: list[tuple] = field(default_factory=list)

    def run(self, product_id: str, model_name: str, feature_set: str, stage: Callable[[], DataFrame]) -> None:
        seen, start = Observation(), time.time()
        name = (product_id, model_name, feature_set)
        try:
            made = stage().observe(seen, F.count(F.lit(1)).alias("rows"))
            made.write.parquet("/".join([self.path, *(f"{k}={v}" for k, v in zip(("product", "model", "set"), name))]))
            self.outcomes.append((*name, "ok", seen.get["rows"], time.time() - start, None))
        except Exception as error:  # noqa: BLE001  any failure of a stage is an outcome
            self.outcomes.append((*name, "error", None, time.time() - start, _reason(error)))

    def status(self) -> DataFrame:
        return self.spark.createDataFrame(self.outcomes, STATUS)


def _reason(error: Exception) -> str:
    """What an in-plan check said, or else the first line of the error."""
    lines = [x for x in str(error).splitlines() if x.strip()]
    said = [x.split("[USER_RAISED_EXCEPTION]", 1)[1].split("SQLSTATE")[0] for x in lines if "[USER_RAISED_EXCEPTION]" in x]
    return (said or lines or [type(error).__name__])[0].strip()
