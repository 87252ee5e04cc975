"""Model registry as tables: runs with metrics, versions with stages, promotion rule and comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from txquality import schema as S
from txquality.sources import files

_VERSIONS = (
    "model string, version int, run_id string, "
    + ", ".join(f"{k} double" for k in S.METRIC_KEYS)
    + ", threshold double, production_metric double, promoted boolean"
)


@dataclass(frozen=True)
class ModelTable:
    """Training runs and model versions as an append-only table; stages are derived from it, never rewritten."""

    spark: SparkSession
    path: str

    def versions(self) -> DataFrame:
        return files.read_or_empty(self.spark, "parquet", self.path, _VERSIONS)

    def register(self, run: DataFrame, model: str, run_id: str, promote: bool = True) -> dict:
        """Append a one-row run as the next version of ``model``; promoted when it beats production and may."""
        known = self.versions().filter(F.col("model") == model)
        state = known.agg(
            F.coalesce(F.max("version"), F.lit(0)).alias("last"),
            F.max_by("pr_auc", F.when(F.col("promoted"), F.col("version"))).alias("production"),
        ).first()
        production = F.lit(state["production"]).cast("double")
        row = run.select(
            F.lit(model).alias("model"),
            F.lit(state["last"] + 1).cast("int").alias("version"),
            F.lit(run_id).alias("run_id"),
            *[F.col(k).cast("double").alias(k) for k in S.METRIC_KEYS],
            "threshold",
            production.alias("production_metric"),
            (promote_rule(F.col("pr_auc"), production) & F.lit(promote)).alias("promoted"),
        )
        row.coalesce(1).write.mode("append").parquet(self.path)
        return self.versions().filter((F.col("model") == model) & (F.col("version") == state["last"] + 1)).first().asDict()

    def staged(self) -> DataFrame:
        return stages(self.versions())


def promote_rule(candidate: Column, production: Column) -> Column:
    """Promote the first candidate, and later ones only when strictly better."""
    return production.isNull() | F.coalesce(candidate > production, F.lit(False))


def gate_replay(versions: DataFrame, model: str = "model", metric: str = "pr_auc", promote: bool = True) -> DataFrame:
    """Decision per version in order, with the metric of the version then in production.

    A version enters production only by beating it, so production holds the running maximum. The window runs per model
    over its versions, one row per training run.
    """
    w = Window.partitionBy(model).orderBy("version")
    production = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    if not promote:
        return versions.withColumns(
            {"production_metric": F.lit(None).cast("double"), "promoted": F.lit(False)}
        )
    return versions.withColumn("production_metric", production).withColumn(
        "promoted", promote_rule(F.col(metric), F.col("production_metric"))
    )


def stages(decided: DataFrame, model: str = "model") -> DataFrame:
    """Stage of every version now: the last promoted one is in production, promoted ones before it are archived."""
    later = Window.partitionBy(model)
    newest = F.max(F.when(F.col("promoted"), F.col("version"))).over(later)
    stage = (
        F.when(F.col("version") == newest, F.lit("Production"))
        .when(F.col("promoted"), F.lit("Archived"))
        .otherwise(F.lit("Staging"))
    )
    return decided.withColumn("stage", stage)


def latest_per_stage(staged: DataFrame, model: str = "model") -> DataFrame:
    others = [c for c in staged.columns if c not in (model, "stage")]
    return (
        staged.groupBy(model, "stage").agg(F.max_by(F.struct(*others), F.col("version")).alias("_v")).select(model, "stage", "_v.*")
    )


def compare(staged: DataFrame, model: str = "model", metrics: list[str] | None = None) -> DataFrame:
    """One row per model: newest candidate and production with metric differences; NULL where one side is missing."""
    metrics = metrics or S.METRIC_KEYS
    latest = latest_per_stage(staged, model)
    state = F.struct("version", "run_id", *metrics)
    sides = latest.groupBy(model).agg(
        F.max(F.when(F.col("stage") == "Staging", state)).alias("c"),
        F.max(F.when(F.col("stage") == "Production", state)).alias("p"),
    )
    return sides.select(
        model,
        F.col("c.version").alias("candidate_version"),
        F.col("p.version").alias("production_version"),
        *[(F.col(f"c.{m}") - F.col(f"p.{m}")).alias(f"delta_{m}") for m in metrics],
    )


def best_run(runs: DataFrame, metric: str = "pr_auc", groups: list[str] | None = None) -> DataFrame:
    """Run with the highest metric; the first run id on ties."""
    others = [c for c in runs.columns if c not in (groups or [])]
    best = F.min_by(F.struct(*others), F.struct(-F.coalesce(F.col(metric), F.lit(-1.0)), F.col("run_id")))
    grouped = runs.groupBy(*groups).agg(best.alias("_b")) if groups else runs.agg(best.alias("_b"))
    return grouped.select(*(groups or []), "_b.*")


def with_run_metrics(versions: DataFrame, runs: DataFrame) -> DataFrame:
    return versions.join(runs, "run_id")
