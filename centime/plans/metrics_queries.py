"""Evaluation queries over long (model, label, prediction) tables
(A18, A26-A32, T7, T8, J11, L13, L15-L17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dims
from ..operators import forecast as FC
from ..operators import metrics as MT
from ..operators import scoring as SC
from ..operators import series as S
from ..sources.tables import Ledger
from . import scoring_queries as SQ
from . import series_queries as SEQ
from . import unify_queries as UQ
from .oracle_views import R, with_views
from .registry import query
from ..session import materialize


# ----------------------------------------------- categorisation baseline ---

def merchant_majority(df: DataFrame) -> DataFrame:
    """Baseline categoriser: each (lower-cased) merchant's most frequent
    category (ties -> alphabetically first), applied back to every row.
    Counts are pre-aggregated per (merchant, category) before ranking."""
    m = F.lower("merchant")
    c = df.groupBy(m.alias("_m"), "category").agg(F.count("*").alias("_n"))
    best = c.groupBy("_m").agg(F.min_by("category", F.struct(-F.col("_n"), F.col("category"))).alias("prediction"))
    return df.withColumn("_m", m).join(best, "_m", "inner").drop("_m")


def _clf(spark, sf_dir):
    d = UQ.deduped_table(spark, sf_dir)
    return merchant_majority(d).select(F.col("category").alias("label"), "prediction")


_CLF_CTE = """mm AS (SELECT lower(merchant) AS m, category, COUNT(*) AS n FROM dd GROUP BY lower(merchant), category),
best AS (SELECT m, arg_min(category, (-n, category)) AS prediction FROM mm GROUP BY m),
clf AS (SELECT d.category AS label, b.prediction FROM dd d JOIN best b ON b.m = lower(d.merchant)),
pc AS (
  SELECT cls, COALESCE(s.support, 0) AS support, COALESCE(t.tp, 0) AS tp, COALESCE(p.pn, 0) AS predicted_n FROM
    (SELECT label AS cls FROM clf UNION SELECT prediction FROM clf) k
    LEFT JOIN (SELECT label, COUNT(*) AS support FROM clf GROUP BY label) s ON s.label = k.cls
    LEFT JOIN (SELECT prediction, COUNT(*) AS pn FROM clf GROUP BY prediction) p ON p.prediction = k.cls
    LEFT JOIN (SELECT label, COUNT(*) AS tp FROM clf WHERE label = prediction GROUP BY label) t ON t.label = k.cls),
pc2 AS (SELECT *, CASE WHEN predicted_n > 0 THEN tp / predicted_n ELSE 0.0 END AS prec,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec FROM pc),
pc3 AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM pc2)"""


def _clf_sql(body: str) -> str:
    return with_views(body, *UQ._VIEWS, extra_ctes=UQ.RAW_CTES + ",\n" + _CLF_CTE)


@query("confusion_matrix", "A29,L13", oracle=_clf_sql(
    "SELECT label AS actual, prediction AS predicted, COUNT(*) AS n FROM clf GROUP BY label, prediction"))
def q_confusion(spark, sf_dir):
    return MT.confusion(_clf(spark, sf_dir), [])


@query("classification_report", "A28,L13", oracle=_clf_sql(f"""
SELECT cls, support, tp, predicted_n, {R('prec')} AS precision, {R('rec')} AS recall, {R('f1')} AS f1 FROM pc3"""))
def q_classification_report(spark, sf_dir):
    per_class, _ = MT.classification_metrics(_clf(spark, sf_dir), [])
    return per_class


@query("classification_summary", "A28,L13,T8", oracle=_clf_sql(f"""
SELECT SUM(support) AS n, {R('SUM(tp) / SUM(support)')} AS accuracy, {R('avg(f1)')} AS macro_f1 FROM pc3"""))
def q_classification_summary(spark, sf_dir):
    _, overall = MT.classification_metrics(_clf(spark, sf_dir), [])
    return overall


# --------------------------------------------------- fraud rule scoring ---

def _fraud_scores(spark, sf_dir):
    f = SC.fraud_risk(SQ._events(spark, sf_dir))
    return f.select(F.col("is_foreign_currency").alias("label"), F.col("fraud_probability").alias("score"))


_SCORES = SQ.FEAT_CTES + f""",
sc AS (SELECT is_foreign_currency AS label, {R('p', 4)} AS score FROM prob)"""


@query("fraud_rule_metrics", "A30,A18,L17", oracle=with_views(f"""
SELECT n, positives, tp, fp, tn, fn, {R('rec')} AS recall, {R('prec')} AS precision,
       {R('CASE WHEN rec + prec > 0 THEN 2 * rec * prec / (rec + prec) ELSE 0.0 END')} AS f1,
       {R('fp / greatest(1, fp + tn)')} AS fpr, {R('positives / n')} AS prevalence,
       {R('(n - positives) / greatest(1, positives)')} AS class_weight
FROM (SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rec,
             CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS prec FROM (
      SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE label = 1) AS positives,
             COUNT(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp, COUNT(*) FILTER (WHERE label <> 1 AND score >= 0.5) AS fp,
             COUNT(*) FILTER (WHERE label <> 1 AND score < 0.5) AS tn, COUNT(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn
      FROM sc))""", "v_risk_events", extra_ctes=_SCORES))
def q_fraud_rule_metrics(spark, sf_dir):
    return MT.binary_metrics(_fraud_scores(spark, sf_dir), [])


@query("fraud_rule_ranking", "A31,L17", oracle=with_views(f"""
SELECT {R('(SUM(cp * mid) - SUM(cp) * (SUM(cp) + 1) / 2.0) / (SUM(cp) * SUM(c - cp))')} AS roc_auc,
       {R('SUM(cp * (cum_tp / cum_n)) / SUM(cp)')} AS average_precision
FROM (SELECT *, COALESCE(SUM(c) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2.0 AS mid,
             SUM(cp) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_tp,
             SUM(c) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_n
      FROM (SELECT score AS s, COUNT(*) AS c, COUNT(*) FILTER (WHERE label = 1) AS cp FROM sc GROUP BY score))""",
    "v_risk_events", extra_ctes=_SCORES))
def q_fraud_rule_ranking(spark, sf_dir):
    return MT.ranking_metrics(_fraud_scores(spark, sf_dir), [])


# ------------------------------------------------ forecasting leaderboard ---

def _candidates(f: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Three baseline candidates on the same rows: seasonal, last value,
    7-day mean (each floored at 0; missing -> series mean)."""
    p = FC.seasonal_predict(f, model, keys)
    gm = F.col("_gm")
    p = p.join(model.select(*keys, F.col("global_mean").alias("_gm")), keys)
    arr = F.array(
        F.struct(F.lit("seasonal").alias("model"), F.col("prediction").alias("p")),
        F.struct(F.lit("last_value").alias("model"), F.greatest(F.lit(0.0), F.coalesce("lag_1", gm)).alias("p")),
        F.struct(F.lit("mean_7").alias("model"), F.greatest(F.lit(0.0), F.coalesce("rolling_mean_7", gm)).alias("p")))
    return p.select("nation", "date", "split", "cv_block", F.col("total_spend").alias("y"), F.explode(arr).alias("c")) \
            .select("nation", "date", "split", "cv_block", "y", "c.model", "c.p")


def _leader_long(spark, sf_dir):
    f = materialize(S.expanding_folds(S.chronological_split(SEQ.nation_features(spark, sf_dir), ["nation"]), ["nation"]))
    model = FC.seasonal_model(FC.seasonal_fit(f.filter(F.col("split") == "train"), ["nation"]), ["nation"])
    return _candidates(f, model, ["nation"])


_LEAD_CTES = """cv AS (SELECT *, CAST(CASE WHEN sz > 0 AND rn > n - sz * 5 THEN floor((rn - (n - sz * 5) - 1) / sz) ELSE -1 END AS INTEGER) AS cv_block
       FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY nation ORDER BY date) AS rn, COUNT(*) OVER (PARTITION BY nation) AS n,
                    floor(COUNT(*) OVER (PARTITION BY nation) / 6) AS sz FROM sp)),
cand AS (
  SELECT c.nation, c.date, c.split, c.cv_block, c.total_spend AS y, 'seasonal' AS model,
         greatest(0.0, COALESCE(c.rolling_mean_7, m.global_mean) * m.multiplier) AS p
  FROM cv c JOIN mdl m ON m.nation = c.nation AND m.dow = isodow(c.date) - 1
  UNION ALL SELECT c.nation, c.date, c.split, c.cv_block, c.total_spend, 'last_value', greatest(0.0, COALESCE(c.lag_1, g.global_mean))
  FROM cv c JOIN mdl_gm g ON g.nation = c.nation
  UNION ALL SELECT c.nation, c.date, c.split, c.cv_block, c.total_spend, 'mean_7', greatest(0.0, COALESCE(c.rolling_mean_7, g.global_mean))
  FROM cv c JOIN mdl_gm g ON g.nation = c.nation)"""


def _metric_sql(src: str, by: str) -> str:
    return f"""SELECT {by}, COUNT(*) AS n, {R('avg(abs(y - p))')} AS mae, {R('sqrt(avg((y - p) * (y - p)))')} AS rmse,
       {R('CASE WHEN sst > 0 THEN 1 - sse / sst END')} AS r2, {R('max(abs(y - p))')} AS max_error,
       {R('COALESCE(avg(CASE WHEN y > 1.0 THEN abs((y - p) / y) END) * 100.0, 0.0)')} AS mape
FROM (SELECT *, SUM((y - p) * (y - p)) OVER (PARTITION BY {by}) AS sse, SUM((y - ybar) * (y - ybar)) OVER (PARTITION BY {by}) AS sst
      FROM (SELECT *, avg(y) OVER (PARTITION BY {by}) AS ybar FROM {src}))
GROUP BY {by}, sse, sst"""


def _lead_sql(body: str) -> str:
    extra = (SEQ._feat_cte("nation") + ",\n" + SEQ._SPLIT + ",\n"
             + SEQ._fit_cte("(SELECT * FROM sp WHERE split = 'train')", "nation") + ",\n" + _LEAD_CTES)
    return SEQ._nation_sql(body, extra)


@query("forecast_model_metrics", "A27,L15,L11", oracle=_lead_sql(_metric_sql("(SELECT * FROM cand WHERE split = 'test')", "model")))
def q_forecast_model_metrics(spark, sf_dir):
    long = _leader_long(spark, sf_dir).filter(F.col("split") == "test")
    return MT.regression_metrics(long, ["model"])


# the rows before fold k, once for every fold that learns from them
_CV_CTES = f"""cvfit AS (SELECT c.*, c.nation || '|' || k.k AS nk FROM cv c JOIN range(0, 5) k(k) ON c.cv_block < k.k),
{SEQ._fit_cte("cvfit", "nk", "cm")},
cvrow AS (SELECT *, nation || '|' || cv_block AS nk FROM cv WHERE cv_block >= 0),
cvcand AS (
  SELECT c.cv_block, c.total_spend AS y, 'seasonal' AS model, greatest(0.0, COALESCE(c.rolling_mean_7, m.global_mean) * m.multiplier) AS p
  FROM cvrow c JOIN cm m ON m.nk = c.nk AND m.dow = isodow(c.date) - 1
  UNION ALL SELECT c.cv_block, c.total_spend, 'last_value', greatest(0.0, COALESCE(c.lag_1, g.global_mean)) FROM cvrow c JOIN cm_gm g ON g.nk = c.nk
  UNION ALL SELECT c.cv_block, c.total_spend, 'mean_7', greatest(0.0, COALESCE(c.rolling_mean_7, g.global_mean)) FROM cvrow c JOIN cm_gm g ON g.nk = c.nk)"""


def _cv_sql(body: str) -> str:
    extra = SEQ._feat_cte("nation") + ",\n" + SEQ._SPLIT + ",\n" + _LEAD_CTES[:_LEAD_CTES.index(",\ncand AS")] + ",\n" + _CV_CTES
    return SEQ._nation_sql(body, extra)


@query("forecast_cv_means", "A32,W10", oracle=_cv_sql(f"""
SELECT model, {R('avg(mae)')} AS cv_mae FROM (SELECT model, cv_block, avg(abs(y - p)) AS mae FROM cvcand
GROUP BY model, cv_block) GROUP BY model"""))
def q_forecast_cv_means(spark, sf_dir):
    """Every fold is scored by models of the rows before it (refitted fold by fold)."""
    f = materialize(S.expanding_folds(SEQ.nation_features(spark, sf_dir).withColumn("split", F.lit("")), ["nation"]))
    long = _candidates(f.filter(F.col("cv_block") >= 0), FC.seasonal_fit_folds(f, ["nation"]), ["nation", "cv_block"])
    per_fold = long.groupBy("model", "cv_block").agg(F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"))
    return MT.fold_mean(per_fold, "model", "mae")


@query("forecast_leaderboard", "J11,T7,T8", oracle=_lead_sql(f"""
SELECT COALESCE(a.model, b.model) AS model, a.mae AS mae_a, b.mae AS mae_b, {R('a.mae - b.mae')} AS gap,
       a.model = (SELECT arg_min(model, (mae, -r2)) FROM ({_metric_sql("(SELECT * FROM cand WHERE split = 'test')", "model")})) AS is_best
FROM ({_metric_sql("(SELECT * FROM cand WHERE split = 'test')", "model")}) a
FULL OUTER JOIN ({_metric_sql("(SELECT * FROM cand WHERE split = 'train')", "model")}) b ON a.model = b.model"""))
def q_forecast_leaderboard(spark, sf_dir):
    long = _leader_long(spark, sf_dir)
    test = MT.regression_metrics(long.filter(F.col("split") == "test"), ["model"])
    train = MT.regression_metrics(long.filter(F.col("split") == "train"), ["model"])
    board = MT.leaderboard_gap(test, train, "model", "mae")
    best = MT.select_best(test, "model", F.struct(F.col("mae") * -1, F.col("r2"))).withColumnRenamed("best_model", "_best")
    return UQ._one_row_join(board, best).withColumn("is_best", F.col("model") == F.col("_best")).drop("_best")


# ---------------------------------------------------------- budgets ---

@query("budget_conservation", "A26,L16", oracle=with_views(f"""
SELECT {R('avg(abs((' + ' + '.join(dims.CATEGORIES) + ' + savings) - monthly_income))')} AS conservation_error FROM alloc""",
    "v_profiles", extra_ctes=SQ._alloc_sql()))
def q_budget_conservation(spark, sf_dir):
    a = SQ._alloc(spark, sf_dir)
    tot = None
    for c in dims.CATEGORIES + ["savings"]:
        tot = F.col(c) if tot is None else tot + F.col(c)
    return MT.conservation_error(a.withColumn("_pred_total", tot), [], "_pred_total", "monthly_income")


@query("budget_target_errors", "L16,A27", oracle=SQ._rec_sql(_metric_sql(
    "(SELECT category, actual_spend AS y, recommended_budget AS p FROM rec3 WHERE actual_spend IS NOT NULL)", "category")))
def q_budget_target_errors(spark, sf_dir):
    db = Ledger(spark, sf_dir)
    rec = SC.recommend_budget(SQ._alloc(spark, sf_dir), SQ._feb_actual(db)).filter(F.col("actual_spend").isNotNull())
    return MT.regression_metrics(rec.select("category", F.col("actual_spend").alias("y"),
                                            F.col("recommended_budget").alias("p")), ["category"])

