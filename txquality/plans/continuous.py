"""Continuous training: admit a batch, append it, count what is pending, and from a threshold on version, train, check drift and register.

A batch may be run again at any time, after a crash as well as after its end, and leaves the same state. What it leaves behind is in folders
named after it; its version is found again by the batch in the manifest; and every step records its outcome, so that a repeat
skips what is done and tries again what failed. Two rules for failures: if no version can be made, the pending count stays and the next
batch tries again; if learning is busy, the version stands, the count starts over and nothing is learned this time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from txquality.operators import admission
from txquality.plans import versions
from txquality.sources import files

_CONTROL = "pending long, batch_id int"
_STEPS = "batch_id int, step_no int, step string, status string, row_count long, result string, error string"
#: A job gets the rows of the new version and the name of its batch; what it returns is kept as text.
Step = tuple[str, Callable[[DataFrame, str], object]]


@dataclass
class Chain:
    """``steps`` are the named jobs that learn from the rows of a new version, in order: see ``jobs.learning_steps``."""

    spark: SparkSession
    folder: str
    threshold: int
    steps: list[Step] = field(default_factory=list)
    busy: Callable[[], bool] = lambda: False

    @property
    def store(self) -> versions.Snapshots:
        return versions.Snapshots(self.spark, f"{self.folder}/versions")

    def pending(self, before: int) -> int:
        """Pending rows after the last batch before this one."""
        control = files.read_or_empty(self.spark, "parquet", f"{self.folder}/control", _CONTROL)
        row = control.filter(F.col("batch_id") < before).agg(F.max_by("pending", "batch_id")).first()
        return row[0] or 0

    def run(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Take in one batch; returns its steps in order: (batch_id, step_no, step, status, row_count, result, error)."""
        done: list[tuple] = []
        judged = admission.judged(batch)
        judged.write.mode("overwrite").partitionBy("is_valid").parquet(f"{self.folder}/offered/batch_id={batch_id}")
        offered = self.spark.read.parquet(f"{self.folder}/offered").withColumn("is_valid", F.col("is_valid").cast("boolean"))
        sizes = offered.filter(F.col("batch_id") == batch_id).agg(F.count(F.lit(1)), F.count_if("is_valid")).first()
        pending = self.pending(batch_id) + sizes[1]
        reached = pending >= self.threshold
        counts = (("admit", "completed", sizes[0]), ("append", "completed", sizes[1]), ("count", "reached" if reached else "pending", pending))
        done += [(*count, None, None) for count in counts]
        if reached:
            rows = offered.filter(F.col("is_valid") & (F.col("batch_id") <= batch_id)).drop("is_valid", "reasons")
            pending = self._learn(rows, pending, batch_id, done)
        control = self.spark.createDataFrame([(pending,)], "pending long")
        control.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/control/batch_id={batch_id}")
        return self.spark.createDataFrame([(batch_id, i + 1, *step) for i, step in enumerate(done)], _STEPS)

    def _learn(self, rows: DataFrame, pending: int, batch_id: int, done: list) -> int:
        """Version and learn; returns what stays pending."""
        key = f"batch-{batch_id}"
        try:
            version = self.store.publish(rows, "continuous", rows_changed=pending, batch=key)
        except Exception as error:  # noqa: BLE001  any failure leaves the rows pending
            done.append(("version", "failed", pending, None, _first_line(error)))
            return pending
        current = self.store.read(version)
        total = current.count()
        done.append(("version", "completed", total, str(version), None))
        recorded = {r["step"]: (r["status"], r["result"]) for r in self._outcomes(batch_id).collect()}  # one row per step
        busy = self.busy()
        for name, job in self.steps:
            status, result = recorded.get(name, ("missing", None))
            error = None
            if status == "versioned" or (busy and status != "completed"):
                status, result = "versioned", None
            elif status != "completed":
                try:
                    status, result = "completed", job(current, key)
                except Exception as raised:  # noqa: BLE001  later steps build on this one
                    status, error = "failed", _first_line(raised)
            result = None if result is None else str(result)
            self._record(batch_id, name, status, result, error)
            done.append((name, status, 0 if status == "versioned" else total, result, error))
            if status == "failed":
                break
        return 0

    def _outcomes(self, batch_id: int) -> DataFrame:
        schema = "status string, result string, error string, batch_id int, step string"
        return files.read_or_empty(self.spark, "parquet", f"{self.folder}/outcomes", schema).filter(F.col("batch_id") == batch_id)

    def _record(self, batch_id: int, step: str, status: str, result: str | None, error: str | None) -> None:
        row = self.spark.createDataFrame([(status, result, error)], "status string, result string, error string")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/outcomes/batch_id={batch_id}/step={step}")


def _first_line(error: Exception) -> str:
    return f"{type(error).__name__}: {error}".splitlines()[0][:500]
