"""Training, evaluation and scoring of the two classifiers with MLlib."""

from __future__ import annotations

import hashlib
import math
import pathlib
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.storagelevel import StorageLevel

from txquality import schema as S
from txquality.functions import columns as C
from txquality.plans import evaluation, splits
from txquality.session import checkpointed


def given_params(estimator) -> dict[str, str]:
    """Kind of an estimator and the values it was given, as text for the run log."""
    columns = ("featuresCol", "labelCol", "weightCol")
    given = {p.name: str(v) for p, v in estimator.extractParamMap().items() if estimator.isSet(p) and p.name not in columns}
    return {"model_type": type(estimator).__name__, "class_weight": "balanced over all rows", **given}


def code_version() -> str:
    """Digest of the package's source files: changes with the code that trained a model."""
    digest = hashlib.sha256()
    for path in sorted(pathlib.Path(__file__).resolve().parent.parent.rglob("*.py")):
        if "llm" not in path.parts:
            digest.update(path.read_bytes())
    return digest.hexdigest()[:12]


def with_balanced_weights(df: DataFrame, label: str = S.TARGET) -> DataFrame:
    """Add ``weight``: two literals, so no join is needed."""
    weights = {r[label]: r["weight"] for r in evaluation.class_weights(df, label).collect()}  # one row per class
    expr = F.lit(None).cast("double")
    for value, weight in weights.items():
        expr = F.when(F.col(label) == value, F.lit(weight)).otherwise(expr)
    return df.withColumn("weight", expr)


def scaler_stage(train: DataFrame, features: list[str]) -> SQLTransformer:
    """Standard scaling with the population deviation as a pipeline stage that is saved with the model."""
    stats = evaluation.scaler_stats(train, features).collect()  # one row per feature
    terms = ", ".join(f"(`{r['feature']}` - {r['mean']!r}D) / {(r['std'] or 1.0)!r}D AS `s_{r['feature']}`" for r in stats)
    return SQLTransformer(statement=f"SELECT *, {terms} FROM __THIS__")


def estimator(name: str, weight_sum: float, trees: int = 200, depth: int = 12):
    common = {"featuresCol": "features", "labelCol": S.TARGET, "weightCol": "weight"}
    if name == "logreg_baseline":
        # Sum of losses with penalty 1/2 |w|^2 equals mean loss with regParam 1 / sum of weights.
        return LogisticRegression(
            **common, maxIter=1000, tol=1e-8, elasticNetParam=0.0, regParam=1.0 / weight_sum, standardization=False
        )
    if name == "rf_balanced_v1":
        # The nodes of a row in all trees are kept from level to level, which changes no tree.
        return RandomForestClassifier(**common, numTrees=trees, maxDepth=depth, seed=42, maxMemoryInMB=1024, cacheNodeIds=True)
    raise ValueError(f"unknown model {name}")


#: Rows that a task takes through all trees of a forest, to grow them by a level or to score, where tasks are few.
FOREST_ROWS = 10_000
#: Rows that a task takes at most where there are many.
MOST_FOREST_ROWS = 1_000_000
#: Trees of a forest over more than ``FOREST_ROWS`` rows that grow at a time.
TREES_TOGETHER = 25


def dealt(train: DataFrame, task_rows: int = FOREST_ROWS, most_rows: int = MOST_FOREST_ROWS) -> DataFrame:
    """The rows in as many partitions as they need, in an order that does not depend on how they arrive.

    The work on a row is a path through every tree, far more than reading it, and the files of a small table are one partition. A
    table of no more rows than a task takes is left as it is. Each task also sends the statistics of all nodes, whatever its rows, so that
    beyond two tasks a core there is one a core, or as many rounds of those as ``most_rows`` asks for.
    """
    rows, cores = train.count(), train.sparkSession.sparkContext.defaultParallelism
    tasks = -(-rows // task_rows)
    if tasks > 2 * cores:
        tasks = min(tasks, cores * -(-rows // (cores * most_rows)))
    return train.repartition(tasks).sortWithinPartitions(*train.columns) if tasks > 1 else train


def grown(forest: RandomForestClassifier, rows: DataFrame, together: int = TREES_TOGETHER) -> RandomForestClassificationModel:
    """The forest, ``together`` trees at a time.

    While trees grow, a row holds two numbers for each of them and a task the statistics of all their nodes of a level: 200 trees
    at a time are kept on disk and read again for every level. The groups have seeds of their own.
    """
    trees, seed = forest.getNumTrees(), forest.getSeed()
    if trees <= together:
        return forest.fit(rows)
    groups = [forest.copy({forest.numTrees: min(together, trees - k), forest.seed: seed + 1_000_003 * k}).fit(rows) for k in range(0, trees, together)]
    context = rows.sparkSession.sparkContext
    kind = context._jvm.org.apache.spark.ml.classification
    joined = context._gateway.new_array(kind.DecisionTreeClassificationModel, trees)
    for k, tree in enumerate(tree for group in groups for tree in group._java_obj.trees()):
        joined[k] = tree
    model = RandomForestClassificationModel(kind.RandomForestClassificationModel(forest.uid, joined, groups[0].numFeatures, groups[0].numClasses))
    forest._copyValues(model)._transfer_params_to_java()
    return model


def fit(name: str, train: DataFrame, features: list[str] | None = None, **params) -> tuple[PipelineModel, dict[str, str]]:
    """Fit scaler and classifier: (model, parameters used). The training rows are kept in memory and on disk meanwhile."""
    features = features or S.FEATURES
    rows = train.select(*features, S.TARGET)
    kept = with_balanced_weights(dealt(rows) if name.startswith("rf") else rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        scaler = scaler_stage(kept, features)
        assembler = VectorAssembler(inputCols=[f"s_{c}" for c in features], outputCol="features")
        weight_sum = kept.agg(F.sum("weight")).first()[0]
        chosen = estimator(name, weight_sum, **params)
        if not name.startswith("rf") or kept.count() <= FOREST_ROWS:
            return Pipeline(stages=[scaler, assembler, chosen]).fit(kept), given_params(chosen)
        ready = assembler.transform(scaler.transform(kept)).select("features", S.TARGET, "weight").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return PipelineModel([scaler, assembler, grown(chosen, ready)]), given_params(chosen)
        finally:
            ready.unpersist()
    finally:
        kept.unpersist()


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``probability_fraud``; works on batches and streams, without Python on rows."""
    scored = model.transform(df)
    scaled = [c for c in scored.columns if c.startswith("s_") and c[2:] in df.columns]
    return scored.withColumn("probability_fraud", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction", *scaled
    )


def train_and_evaluate(name: str, split: DataFrame, features: list[str] | None = None, tags: dict | None = None, **params):
    """Fit on the train fold, choose the threshold and measure on the test fold: (model, run row as DataFrame)."""
    return evaluated(name, split, features, tags, **params)[:2]


def evaluated(name: str, split: DataFrame, features: list[str] | None = None, tags: dict | None = None, **params):
    """As ``train_and_evaluate``, with the scored test rows: (model, run row, rows). A forest's are stored, as each pass over them would go through all trees."""
    train, test = split.filter("fold = 'train'"), split.filter("fold = 'test'")
    model, logged = fit(name, train, features, **params)
    scored = score(model, dealt(test) if name.startswith("rf") else test)
    if name.startswith("rf"):
        scored = checkpointed(scored)
    result = evaluation.metrics(scored, score="probability_fraud", label=S.TARGET)
    sizes = split.agg(F.count_if(F.col("fold") == "train"), F.count_if(F.col("fold") == "test")).first()
    tags = {"trained_by": "txquality", "code_version": code_version(), **(tags or {})}
    text_map = F.create_map(*[F.lit(x) for pair in logged.items() for x in pair])
    tag_map = F.create_map(*[F.lit(x) for pair in tags.items() for x in pair])
    run = result.select(
        F.lit(name).alias("model"),
        F.lit(sizes[0]).cast("long").alias("n_train"),
        F.lit(sizes[1]).cast("long").alias("n_test"),
        "*",
        text_map.alias("params"),
        tag_map.alias("tags"),
    )
    return model, run, scored


def split_features(feats: DataFrame, row_id: str = "transaction_id") -> DataFrame:
    return splits.stratified_split(feats, S.TARGET, row_id)


def save_model(model: PipelineModel, run: DataFrame, path: str) -> None:
    """Model and, beside it, its run row: the served threshold always belongs to the model."""
    model.write().overwrite().save(f"{path}/model")
    run.coalesce(1).write.mode("overwrite").parquet(f"{path}/run")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, float]:
    threshold = spark.read.parquet(f"{path}/run").first()["threshold"]
    return PipelineModel.load(f"{path}/model"), threshold


# ---- checks that a model without skill fails ------------------------------------------------------------------------


def logistic_gradient(model: PipelineModel, train: DataFrame, features: list[str] | None = None) -> DataFrame:
    """(largest_gradient, weighted_probability): one aggregate over the training rows.

    ``largest_gradient`` is the largest entry of the gradient of the balanced sum of losses with penalty 1/2 |w|^2 at the fitted
    weights. ``weighted_probability`` is the sum of weight times probability; at the optimum it equals the weight of the positive rows.
    """
    features = features or S.FEATURES
    scored = score(model, with_balanced_weights(train.select(*features, S.TARGET)))
    residual = F.col("weight") * (F.col("probability_fraud") - F.col(S.TARGET))
    stats = {r["feature"]: r for r in evaluation.scaler_stats(train, features).collect()}  # one row per feature
    slopes = []
    for name, w in zip(features, model.stages[-1].coefficients.toArray()):
        scaled = (F.col(name) - F.lit(stats[name]["mean"])) / F.lit(stats[name]["std"] or 1.0)
        slopes.append(F.abs(F.sum(residual * scaled) + F.lit(float(w))))
    return scored.agg(
        F.greatest(*slopes, F.abs(F.sum(residual))).alias("largest_gradient"),
        F.sum(F.col("weight") * F.col("probability_fraud")).alias("weighted_probability"),
    )


def skill(model, train: DataFrame) -> DataFrame:
    """(n_train, positives, above_share, ranks_better): PR-AUC against the share of positive rows and ROC-AUC against a half.

    Both are strict, so a constant score fails them.
    """
    scored = model.score(train) if isinstance(model, BalancedForest) else score(model, train)
    measured = evaluation.areas(evaluation.curve(scored, "probability_fraud", S.TARGET)).first()
    counts = train.agg(F.count(F.lit(1)).alias("n_train"), F.count_if(F.col(S.TARGET) == 1).alias("positives"))
    return counts.select(
        "n_train",
        "positives",
        (F.lit(measured["pr_auc"]) > F.col("positives") / F.col("n_train")).alias("above_share"),
        (F.lit(measured["roc_auc"]) > 0.5).alias("ranks_better"),
    )


# ---- forest whose trees balance the classes of their own draws -------------------------------------------------------

POISSON_STEPS = 12  # the chance of more than 12 draws of a row is below 1e-10


def draws_of(tree: int, row_id: str, seed: int) -> Column:
    """How often a row is drawn for a tree: Poisson with mean one, a function of seed, tree and row id alone."""
    u = C.uniform(seed, f"tree{tree}", F.col(row_id))
    below, steps = 0.0, F.lit(0)
    for k in range(POISSON_STEPS):
        below += math.exp(-1) / math.factorial(k)
        steps = steps + (u >= F.lit(below)).cast("int")
    return steps


@dataclass
class BalancedForest:
    trees: list
    assembler: VectorAssembler

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``probability_fraud``, the mean over the trees."""
        scored = self.assembler.transform(df)
        marks = [f"_p{k}" for k in range(len(self.trees))]
        for tree, mark in zip(self.trees, marks):
            scored = tree.setRawPredictionCol("").setPredictionCol("").setProbabilityCol(mark).transform(scored)
        votes = [vector_to_array(m)[1] for m in marks]
        total = votes[0]
        for v in votes[1:]:
            total = total + v
        return scored.withColumn("probability_fraud", total / len(votes)).drop("_features", *marks)


def tree_weights(train: DataFrame, row_id: str, trees: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows with a weight column ``_w<k>`` per tree, totals): both classes of a tree's draws get the same total weight.

    ``totals`` has one row per class with the number of draws of every tree, from one aggregate for all trees.
    """
    drawn = train.withColumns({f"_w{k}": draws_of(k, row_id, seed) for k in range(trees)})
    totals = drawn.groupBy(S.TARGET).agg(*[F.sum(f"_w{k}").alias(f"d{k}") for k in range(trees)])
    found = totals.collect()  # one row per class
    weights = {}
    for k in range(trees):
        all_drawn = sum(r[f"d{k}"] for r in found)
        factor = F.lit(0.0)
        for r in found:
            if r[f"d{k}"]:
                factor = F.when(F.col(S.TARGET) == r[S.TARGET], F.lit(all_drawn / (len(found) * r[f"d{k}"]))).otherwise(factor)
        weights[f"_w{k}"] = F.col(f"_w{k}") * factor
    return drawn.withColumns(weights), totals


def fit_balanced_forest(
    train: DataFrame, row_id: str, features: list[str] | None = None, trees: int = 200, depth: int = 12, seed: int = 42
) -> BalancedForest:
    """A forest whose trees weight the classes within their own bootstrap, not over all rows.

    MLlib's forest has one weight column for all its trees, so each tree is a forest of one on its own weights; candidates at a node
    are the square root of the features. The rows are assembled once and kept in memory and on disk meanwhile.
    """
    features = features or S.FEATURES
    assembler = VectorAssembler(inputCols=features, outputCol="_features")
    weighted, _ = tree_weights(train.select(row_id, *features, S.TARGET), row_id, trees, seed)
    kept = assembler.transform(weighted).select("_features", S.TARGET, *[f"_w{k}" for k in range(trees)]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        common = {"featuresCol": "_features", "labelCol": S.TARGET, "numTrees": 1, "featureSubsetStrategy": "sqrt", "bootstrap": False}
        grown = [
            RandomForestClassifier(**common, weightCol=f"_w{k}", maxDepth=depth, seed=seed + k).fit(kept.filter(F.col(f"_w{k}") > 0))
            for k in range(trees)
        ]
        return BalancedForest(grown, assembler)
    finally:
        kept.unpersist()
