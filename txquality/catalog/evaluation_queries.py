"""Split, scaling statistics and classifier evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from txquality import schema as S
from txquality.catalog import sql as Q
from txquality.catalog.registry import query
from txquality.functions import columns as C
from txquality.plans import evaluation, marts, splits
from txquality.sources import files, star_tables as st

def split_sql(source: str, key: str, label: str) -> str:
    """The stratified split of a relation as SQL: per class the share of rows with the smallest (hash, key)."""
    return f"""sized as (
  select {label} as class, count(*) as n from {source} group by 1),
quota as (
  select class, n, n * ceil(sum(n) over () * 0.2::double) / sum(n) over () as exact, ceil(sum(n) over () * 0.2::double) as wanted from sized),
ordered as (
  select *, floor(exact) + case when row_number() over (order by exact - floor(exact) desc, n desc, class)
                                <= wanted - sum(floor(exact)) over () then 1 else 0 end as take from quota),
split as (
  select {key}, s.{label} as is_fraud,
         case when row_number() over (partition by s.{label} order by ('0x' || substr(md5('42:' || cast({key} as varchar)), 1, 8))::bigint, {key})
                   <= take then 'test' else 'train' end as fold
  from {source} s join ordered on s.{label} = ordered.class)"""


_SPLIT = f"{Q.CORE}, {split_sql('tx', 'id', 'class')}"


def _split(spark, sf_dir):
    rows = st.raw_core(spark, sf_dir).select("id", F.col("class").alias("is_fraud"))
    return splits.stratified_split(rows, "is_fraud", "id")


@query("stratified_split", f"with {_SPLIT} select id, is_fraud, fold from split")
def stratified_split(spark, sf_dir):
    return _split(spark, sf_dir)


@query("split_counts", f"with {_SPLIT} select fold, is_fraud, count(*) as row_count from split group by 1, 2")
def split_counts(spark, sf_dir):
    return splits.split_counts(_split(spark, sf_dir), "is_fraud")


@query(
    "class_weights",
    f"with {Q.CORE}, {Q.FEATS}, c as (select is_fraud, count(*) as row_count from feats group by 1) "
    f"select is_fraud, row_count, {Q.rounded('sum(row_count) over () / (2.0::double * row_count)', 9)} as weight from c",
)
def class_weights(spark, sf_dir):
    weights = evaluation.class_weights(marts.features_from_raw(st.raw_core(spark, sf_dir)))
    return weights.withColumn("weight", C.rounded(F.col("weight"), 9))


def _scaler_sql() -> str:
    feats = f"""feats as (
      select *, {Q.HOUR} as hour_of_day, ln(amount + 1) as log_amount from tx where amount >= 0)"""
    rows = " union all ".join(
        f"select '{c}' as feature, {Q.rounded(f'avg({c})', 6)} as mean, {Q.rounded(f'stddev_pop({c})', 6)} as std from feats"
        for c in S.FEATURES
    )
    return f"with {Q.FULL}, {feats} {rows}"


@query("scaler_stats", _scaler_sql())
def scaler_stats(spark, sf_dir):
    stats = evaluation.scaler_stats(marts.features_from_raw(st.raw_full(spark, sf_dir)), S.FEATURES)
    return stats.select("feature", C.rounded(F.col("mean"), 6).alias("mean"), C.rounded(F.col("std"), 6).alias("std"))


@query(
    "scaled_features",
    f"with {Q.CORE}, {Q.FEATS} select transaction_id, "
    + ", ".join(
        Q.rounded(f"({c} - avg({c}) over ()) / stddev_pop({c}) over ()", 6) + f" as {c}" for c in S.MONITORED
    )
    + " from feats",
)
def scaled_features(spark, sf_dir):
    feats = marts.features_from_raw(st.raw_core(spark, sf_dir))
    return evaluation.scaled(feats, S.MONITORED).select(
        "transaction_id", *[C.rounded(F.col(c), 6).alias(c) for c in S.MONITORED]
    )


_CURVE = f"""{Q.SCORED}, grouped as (
  select score, sum(case when label = 1 then 1 else 0 end)::bigint as pos, sum(case when label = 1 then 0 else 1 end)::bigint as neg
  from scored group by 1),
pts as (
  select score, pos, neg, (sum(pos) over w)::bigint as tp, (sum(neg) over w)::bigint as fp,
         (sum(pos) over ())::bigint as total_pos, (sum(neg) over ())::bigint as total_neg
  from grouped window w as (order by score desc)),
rated as (
  select *, tp::double / (tp + fp) as p, tp::double / total_pos as r,
         2 * (tp::double / (tp + fp)) * (tp::double / total_pos) / (tp::double / (tp + fp) + tp::double / total_pos + 1e-12) as f1
  from pts)"""


@query(
    "confusion_at_threshold",
    f"""with {Q.SCORED}, c as (
      select count(*) filter (where score >= 0.4998 and label = 1) as true_positives,
             count(*) filter (where score >= 0.4998 and label = 0) as false_positives,
             count(*) filter (where score < 0.4998 and label = 0) as true_negatives,
             count(*) filter (where score < 0.4998 and label = 1) as false_negatives from scored)
    select *, 0.4998::double as threshold, true_positives::double / (true_positives + false_positives) as precision,
           true_positives::double / (true_positives + false_negatives) as recall,
           (2 * true_positives)::double / (2 * true_positives + false_positives + false_negatives) as f1 from c""",
)
def confusion_at_threshold(spark, sf_dir):
    return evaluation.confusion(st.scored_rows(spark, sf_dir), S.DEFAULT_SCORE_THRESHOLD)


@query(
    "score_decision",
    f"with {Q.SCORED} select id, {Q.rounded('score', 6)} as fraud_probability, score >= 0.4998 as decision from scored",
)
def score_decision(spark, sf_dir):
    scored = st.scored_rows(spark, sf_dir).select("id", F.col("score").alias("probability_fraud"))
    return files.rounded_predictions(scored, S.DEFAULT_SCORE_THRESHOLD).drop("probability_fraud")


@query("pr_curve", f"with {_CURVE} select score, tp, fp, p as precision, r as recall from rated")
def pr_curve(spark, sf_dir):
    return evaluation.pr_points(evaluation.curve(st.scored_rows(spark, sf_dir)))


@query(
    "pr_curve_thinned",
    f"""with {_CURVE}, slots as (select *, least(floor(r * 50), 49)::bigint as slot from rated)
    select slot, score, p as precision, r as recall from slots
    qualify row_number() over (partition by slot order by score desc) = 1""",
)
def pr_curve_thinned(spark, sf_dir):
    return evaluation.thinned(evaluation.pr_points(evaluation.curve(st.scored_rows(spark, sf_dir))), 50)


_AP = Q.rounded("sum(pos::double / total_pos * p)", 9)
_ROC = Q.rounded("sum(neg::double * (tp - pos + tp)::double / 2) / max(total_pos::double * total_neg::double)", 9)


@query("average_precision", f"with {_CURVE} select {_AP} as pr_auc from rated")
def average_precision(spark, sf_dir):
    areas = evaluation.areas(evaluation.curve(st.scored_rows(spark, sf_dir)))
    return areas.select(C.rounded(F.col("pr_auc"), 9).alias("pr_auc"))


@query("roc_auc", f"with {_CURVE} select {_ROC} as roc_auc from rated")
def roc_auc(spark, sf_dir):
    areas = evaluation.areas(evaluation.curve(st.scored_rows(spark, sf_dir)))
    return areas.select(C.rounded(F.col("roc_auc"), 9).alias("roc_auc"))


@query(
    "best_threshold_f1",
    f"with {_CURVE} select score as threshold, {Q.rounded('f1', 9)} as f1 from rated order by rated.f1 desc, score asc limit 1",
)
def best_threshold_f1(spark, sf_dir):
    best = evaluation.best_threshold(evaluation.curve(st.scored_rows(spark, sf_dir)))
    return best.select("threshold", C.rounded(F.col("f1"), 9).alias("f1"))


@query(
    "evaluation_metrics",
    f"""with {_CURVE}, a as (select {_AP} as pr_auc, {_ROC} as roc_auc from rated),
    b as (select * from rated order by f1 desc, score asc limit 1)
    select pr_auc, roc_auc, score as threshold, tp as true_positives, fp as false_positives, total_neg - fp as true_negatives,
           total_pos - tp as false_negatives, {Q.rounded('p', 9)} as precision, {Q.rounded('r', 9)} as recall,
           {Q.rounded('(2 * tp)::double / (2 * tp + fp + total_pos - tp)', 9)} as f1 from a, b""",
)
def evaluation_metrics(spark, sf_dir):
    one = evaluation.metrics(st.scored_rows(spark, sf_dir))
    floats = ["pr_auc", "roc_auc", "precision", "recall", "f1"]
    return one.withColumns({c: C.rounded(F.col(c), 9) for c in floats})
