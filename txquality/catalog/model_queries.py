"""Synthetic rows and trained models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from txquality import schema as S
from txquality.catalog import sql as Q
from txquality.catalog.evaluation_queries import split_sql
from txquality.catalog.registry import query
from txquality.functions import columns as C
from txquality.plans import marts, resample, splits, training
from txquality.session import checkpointed
from txquality.sources import files, star_tables as st

SEED = 7


def _base(spark, sf_dir, full=False):
    raw = st.raw_full(spark, sf_dir) if full else st.raw_core(spark, sf_dir)
    return raw.withColumnRenamed("class", "is_fraud").drop("load_id", "row_uid")


def _draws(spark, sf_dir):
    """As many draws as there are rows."""
    return st.table(spark, sf_dir, "events").select(F.col("event_id").alias("draw_id"))


def _u(name: str, key: str = "draw_id") -> str:
    return f"((('0x' || substr(md5('{SEED}:{name}:' || {key}), 1, 13))::bigint)::double + 0.5::double) / 4503599627370496.0::double"


def _drift_sql(intensity: str, columns: str = "", with_v: str = "") -> str:
    p = S.DRIFT_INTENSITY[intensity]
    rate = f"least((select avg(class) from tx) * {p['fraud_multiplier']}::double, 0.5::double)"
    # The suffix keeps the two uniforms of a normal draw apart: seed:component:draw:a and :b.
    return f"""drawn as (
      select event_id as draw_id, floor({_u('pick', 'event_id')} * (select count(*) from events)::double)::bigint as pick from events),
    made as (
      select draw_id, id as source_id,
             ceil((select max(time) from tx) / 86400.0::double) * 86400.0::double + time % 86400 as time, {with_v}
             greatest(0.0::double, amount * {p['amount_scale']}::double * (0.7::double + {1.3 - 0.7!r}::double * {_u('amount')})) as amount,
             ({_u('label')} < {rate})::bigint as is_fraud
      from drawn join tx on tx.id = drawn.pick)"""


@query(
    "synthetic_rows",
    f"with {Q.CORE}, {_drift_sql('strong')} select draw_id, source_id, time, {Q.rounded('amount', 9)} as amount, is_fraud from made",
)
def synthetic_rows(spark, sf_dir):
    rows = resample.synthetic_rows(_base(spark, sf_dir), _draws(spark, sf_dir), "strong", SEED)
    return rows.withColumn("amount", C.rounded(F.col("amount"), 9))


def _normal(v: str) -> str:
    a = f"((('0x' || substr(md5('{SEED}:{v}:' || draw_id || ':a'), 1, 13))::bigint)::double + 0.5::double) / 4503599627370496.0::double"
    b = f"((('0x' || substr(md5('{SEED}:{v}:' || draw_id || ':b'), 1, 13))::bigint)::double + 0.5::double) / 4503599627370496.0::double"
    return f"(sqrt(-2.0::double * ln({a})) * cos(2 * pi() * {b}))"


@query(
    "synthetic_components",
    f"with {Q.FULL}, "
    + _drift_sql("moderate", with_v=" ".join(f"{Q.rounded(f'{v} + 1.0::double * {_normal(v)}', 6)} as {v}," for v in Q.V))
    + f" select draw_id, source_id, time, {', '.join(Q.V)}, {Q.rounded('amount', 9)} as amount, is_fraud from made",
)
def synthetic_components(spark, sf_dir):
    rows = resample.synthetic_rows(_base(spark, sf_dir, full=True), _draws(spark, sf_dir), "moderate", SEED)
    return rows.withColumns(
        {**{v: C.rounded(F.col(v), 6) for v in S.V_COLUMNS}, "amount": C.rounded(F.col("amount"), 9)}
    )


def _split(spark, sf_dir):
    feats = marts.features_from_raw(st.raw_full(spark, sf_dir))
    return splits.stratified_split(feats, S.TARGET, "transaction_id")


@query("lr_scores")
def lr_scores(spark, sf_dir):
    split = _split(spark, sf_dir)
    model, _ = training.fit("logreg_baseline", split.filter("fold = 'train'"))
    scored = training.score(model, split.filter("fold = 'test'"))
    return scored.select("transaction_id", "is_fraud", "probability_fraud")


@query("rf_scores")
def rf_scores(spark, sf_dir):
    split = checkpointed(_split(spark, sf_dir))
    model, _ = training.fit("rf_balanced_v1", split.filter("fold = 'train'"))
    scored = training.score(model, training.dealt(split.filter("fold = 'test'")))
    return scored.select("transaction_id", "is_fraud", "probability_fraud")


@query("model_metrics")
def model_metrics(spark, sf_dir):
    """Run rows of the logistic baseline; the forest goes through the same call."""
    _, run = training.train_and_evaluate("logreg_baseline", _split(spark, sf_dir))
    return run.drop("params", "tags")


def _score_checks(name: str) -> str:
    return (
        f"with {Q.CORE}, {Q.FEATS}, {split_sql('feats', 'transaction_id', 'is_fraud')} "
        f"select '{name}' as model, transaction_id, is_fraud, true as in_range, true as decided from split where fold = 'test'"
    )


def _checked_scores(spark, sf_dir, name):
    """Test rows with a probability within 0 and 1 and a decision that follows the served threshold."""
    split = checkpointed(_split(spark, sf_dir))
    _, run, scored = training.evaluated(name, split)
    threshold = run.first()["threshold"]
    p = F.col("probability_fraud")
    scored = files.rounded_predictions(scored, threshold)
    return scored.select(
        F.lit(name).alias("model"),
        "transaction_id",
        "is_fraud",
        ((p >= 0) & (p <= 1)).alias("in_range"),
        (F.col("decision") == (p >= threshold)).alias("decided"),
    )


@query("lr_score_checks", _score_checks("logreg_baseline"))
def lr_score_checks(spark, sf_dir):
    return _checked_scores(spark, sf_dir, "logreg_baseline")


@query("rf_score_checks", _score_checks("rf_balanced_v1"))
def rf_score_checks(spark, sf_dir):
    return _checked_scores(spark, sf_dir, "rf_balanced_v1")


@query(
    "model_run_checks",
    f"""with {Q.CORE}, {Q.FEATS}, {split_sql('feats', 'transaction_id', 'is_fraud')}
    select 'logreg_baseline' as model, count(*) filter (where fold = 'train') as n_train, count(*) filter (where fold = 'test') as n_test,
      true as counts_add_up, true as metrics_in_range, '1000' as max_iter, 12 as version_length from split""",
)
def model_run_checks(spark, sf_dir):
    """Run row: fold sizes, consistent counts, metrics within 0 and 1, the parameters really used and the code version."""
    _, run = training.train_and_evaluate("logreg_baseline", _split(spark, sf_dir))
    inside = F.lit(True)
    for key in S.METRIC_KEYS:
        inside = inside & (F.col(key) >= 0) & (F.col(key) <= 1)
    total = F.col("true_positives") + F.col("false_positives") + F.col("false_negatives") + F.col("true_negatives")
    return run.select(
        "model",
        "n_train",
        "n_test",
        (total == F.col("n_test")).alias("counts_add_up"),
        inside.alias("metrics_in_range"),
        F.col("params")["maxIter"].alias("max_iter"),
        F.length(F.col("tags")["code_version"]).alias("version_length"),
    )


_TRAIN = f"with {Q.CORE}, {Q.FEATS}, {split_sql('feats', 'transaction_id', 'is_fraud')}"


@query(
    "lr_fit_checks",
    _TRAIN + """ select 'logreg_baseline' as model, count(*) as n_train, count(*) filter (where is_fraud = 1) as positives, true as above_share,
      true as ranks_better, true as at_optimum, round(count(*) / 2.0::double, 1) as weighted_probability from split where fold = 'train'""",
)
def lr_fit_checks(spark, sf_dir):
    """A model that is not the optimum of its loss fails: gradient, calibrated weight of the positive class, skill on its rows."""
    train = _split(spark, sf_dir).filter("fold = 'train'")
    model, _ = training.fit("logreg_baseline", train)
    optimum = training.logistic_gradient(model, train).first()
    return training.skill(model, train).select(
        F.lit("logreg_baseline").alias("model"),
        "*",
        F.lit(optimum["largest_gradient"] < 1e-2).alias("at_optimum"),
        F.lit(round(optimum["weighted_probability"], 1)).alias("weighted_probability"),
    )


@query(
    "rf_fit_checks",
    _TRAIN + """ select 'rf_balanced_v1' as model, count(*) as n_train, count(*) filter (where is_fraud = 1) as positives, true as above_share,
      true as ranks_better from split where fold = 'train'""",
)
def rf_fit_checks(spark, sf_dir):
    """The forest with few trees: a constant or reversed score fails."""
    train = _split(spark, sf_dir).filter("fold = 'train'")
    model, _ = training.fit("rf_balanced_v1", train, trees=10, depth=8)
    return training.skill(model, train).select(F.lit("rf_balanced_v1").alias("model"), "*")


BALANCED_TREES = 6


def _poisson(tree: str) -> str:
    u = f"((('0x' || substr(md5('{SEED}:tree' || {tree} || ':' || transaction_id), 1, 13))::bigint)::double + 0.5::double) / 4503599627370496.0::double"
    below, steps = 0.0, []
    for k in range(training.POISSON_STEPS):
        below += math.exp(-1) / math.factorial(k)
        steps.append(f"(u >= {below!r}::double)::bigint")
    return f"(select {' + '.join(steps)} from (select {u} as u))"


@query(
    "rf_balanced_checks",
    _TRAIN + f""", drawn as (select tree, is_fraud, {_poisson('tree::varchar')} as n from split, range({BALANCED_TREES}) as r(tree) where fold = 'train')
      select tree::bigint as tree, sum(n)::bigint as drawn, (sum(n) filter (where is_fraud = 1))::bigint as drawn_positive, 0.5::double as positive_weight,
        true as above_share, true as ranks_better from drawn group by tree""",
)
def rf_balanced_checks(spark, sf_dir):
    """Draws of every tree, the share of its weight that the positive class has, and the skill of the forest."""
    train = _split(spark, sf_dir).filter("fold = 'train'")
    weighted, _ = training.tree_weights(train, "transaction_id", BALANCED_TREES, SEED)
    per_tree = [
        F.struct(
            F.lit(k).cast("long").alias("tree"),
            F.sum(training.draws_of(k, "transaction_id", SEED)).cast("long").alias("drawn"),
            F.sum(F.when(F.col("is_fraud") == 1, training.draws_of(k, "transaction_id", SEED))).cast("long").alias("drawn_positive"),
            C.rounded(F.sum(F.when(F.col("is_fraud") == 1, F.col(f"_w{k}"))) / F.sum(f"_w{k}"), 9).alias("positive_weight"),
        )
        for k in range(BALANCED_TREES)
    ]
    forest = training.fit_balanced_forest(train, "transaction_id", trees=BALANCED_TREES, depth=6, seed=SEED)
    skill = training.skill(forest, train).first()
    rows = weighted.agg(F.array(*per_tree).alias("rows")).select(F.inline("rows"))
    return rows.withColumns({"above_share": F.lit(skill["above_share"]), "ranks_better": F.lit(skill["ranks_better"])})
