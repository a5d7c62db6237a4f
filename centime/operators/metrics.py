"""Evaluation metrics over long (group, label, prediction) tables
(A18, A26-A32, W6, T7, T8, J11, L13-L17).

Every metric is an aggregate (or a window over a small ordered score table)
so any number of models, series or targets are evaluated in one job.
Results are rounded to 6 decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.money import round_to


def regression_metrics(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """N, MAE, RMSE, R^2 (two-pass: the group mean first), max error and
    MAPE over actual > 1 only (0 when none).  The means, a row a group, are
    broadcast: groups are few and large, and dealt by them their rows would meet
    in a few tasks."""
    mean = df.groupBy(*by).agg(F.avg(y).alias("_ybar"))
    if by:
        j = df.join(F.broadcast(mean), by, "inner")
    else:  # one-row table, broadcast: the big side never moves
        j = df.withColumn("_k", F.lit(1)).join(F.broadcast(mean.withColumn("_k", F.lit(1))), "_k").drop("_k")
    err = F.col(y) - F.col(p)
    g = j.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(err)).alias("_mae"),
        F.avg(err * err).alias("_mse"),
        F.sum(err * err).alias("_sse"),
        F.sum((F.col(y) - F.col("_ybar")) * (F.col(y) - F.col("_ybar"))).alias("_sst"),
        F.max(F.abs(err)).alias("_maxe"),
        F.avg(F.when(F.col(y) > 1.0, F.abs(err / F.col(y)))).alias("_mape"))
    return g.select(*by, "n",
                    round_to("_mae", 6).alias("mae"),
                    round_to(F.sqrt("_mse"), 6).alias("rmse"),
                    round_to(F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst")), 6).alias("r2"),
                    round_to("_maxe", 6).alias("max_error"),
                    round_to(F.coalesce(F.col("_mape") * 100.0, F.lit(0.0)), 6).alias("mape"))


def directional_accuracy(df: DataFrame, by: list[str], order: str, y: str = "y", p: str = "p") -> DataFrame:
    """% of consecutive steps where the predicted change has the sign of
    the actual change; 0 with fewer than 2 rows."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.select(*by, order,
                  (F.signum(F.col(y) - F.lag(y).over(w)) == F.signum(F.col(p) - F.lag(p).over(w))).alias("_ok"))
    g = d.groupBy(*by).agg(F.count("_ok").alias("_n"), F.count_if("_ok").alias("_k"))
    return g.select(*by, F.when(F.col("_n") > 0, round_to(F.col("_k") / F.col("_n") * 100.0, 6))
                    .otherwise(F.lit(0.0)).alias("directional_accuracy"))


def confusion(df: DataFrame, by: list[str], label: str = "label", pred: str = "prediction") -> DataFrame:
    """Counts per (actual, predicted)."""
    return df.groupBy(*by, F.col(label).alias("actual"), F.col(pred).alias("predicted")).agg(
        F.count("*").alias("n"))


def classification_metrics(df: DataFrame, by: list[str], label: str = "label",
                           pred: str = "prediction") -> tuple[DataFrame, DataFrame]:
    """Per class precision/recall/F1/support and per group accuracy and
    macro F1 (zero division -> 0), from the confusion counts."""
    c = confusion(df, by, label, pred)
    tp = c.filter(F.col("actual") == F.col("predicted")).groupBy(*by, F.col("actual").alias("cls")).agg(
        F.sum("n").alias("tp"))
    sup = c.groupBy(*by, F.col("actual").alias("cls")).agg(F.sum("n").alias("support"))
    prd = c.groupBy(*by, F.col("predicted").alias("cls")).agg(F.sum("n").alias("predicted_n"))
    pc = sup.join(prd, by + ["cls"], "full_outer").join(tp, by + ["cls"], "left").fillna(
        0, ["support", "predicted_n", "tp"])
    prec = F.when(F.col("predicted_n") > 0, F.col("tp") / F.col("predicted_n")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    pc = pc.withColumn("precision", prec).withColumn("recall", rec).withColumn(
        "f1", F.when(F.col("precision") + F.col("recall") > 0,
                     2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    per_class = pc.select(*by, "cls", "support", "tp", "predicted_n",
                          round_to("precision", 6).alias("precision"), round_to("recall", 6).alias("recall"),
                          round_to("f1", 6).alias("f1"))
    overall = pc.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("_acc"), F.avg("f1").alias("_mf1"), F.sum("support").alias("n"))
    overall = overall.select(*by, "n", round_to("_acc", 6).alias("accuracy"), round_to("_mf1", 6).alias("macro_f1"))
    return per_class, overall


def binary_metrics(df: DataFrame, by: list[str], label: str = "label", score: str = "score",
                   threshold: float = 0.5) -> DataFrame:
    """A30 + A18: counts at the threshold, recall, precision, F1,
    FPR = fp / max(1, fp + tn), prevalence and class weight (n-pos)/max(1,pos)."""
    pos = F.col(label) == 1
    hit = F.col(score) >= threshold
    g = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(pos).alias("positives"),
        F.count_if(pos & hit).alias("tp"), F.count_if(~pos & hit).alias("fp"),
        F.count_if(~pos & ~hit).alias("tn"), F.count_if(pos & ~hit).alias("fn"))
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    g = g.withColumn("_r", rec).withColumn("_p", prec)
    f1 = F.when(F.col("_r") + F.col("_p") > 0, 2 * F.col("_r") * F.col("_p") / (F.col("_r") + F.col("_p"))).otherwise(0.0)
    return g.select(*by, "n", "positives", "tp", "fp", "tn", "fn",
                    round_to("_r", 6).alias("recall"), round_to("_p", 6).alias("precision"),
                    round_to(f1, 6).alias("f1"),
                    round_to(F.col("fp") / F.greatest(F.lit(1), F.col("fp") + F.col("tn")), 6).alias("fpr"),
                    round_to(F.col("positives") / F.col("n"), 6).alias("prevalence"),
                    round_to((F.col("n") - F.col("positives")) / F.greatest(F.lit(1), F.col("positives")), 6)
                    .alias("class_weight"))


def ranking_metrics(df: DataFrame, by: list[str], label: str = "label", score: str = "score",
                    n_buckets: int = 1024) -> DataFrame:
    """ROC-AUC by mid-ranks and average precision over distinct scores,
    exact and without an ordered window over a whole group.

    Rows are reduced to one row per (group, distinct score) with total and
    positive counts; distinct scores are cut into ~``n_buckets`` ranges at
    approximate quantiles (equal scores share a range); per-range totals are
    prefix-summed over the small (group, range) table and the ordered window
    runs only inside one range.
    AUC = (sum of positives' mid-ranks - P(P+1)/2) / (P N);
    AP  = sum over distinct scores of (tp at score / P) * (tp at >= score / n at >= score).
    """
    s = df.groupBy(*by, F.col(score).alias("s")).agg(
        F.count("*").alias("c"), F.count_if(F.col(label) == 1).alias("cp"))
    cuts = s.agg(F.percentile_approx("s", [i / n_buckets for i in range(1, n_buckets)], 10000)).first()[0]
    cuts = sorted(set(float(x) for x in (cuts or []) if x is not None))
    if cuts:
        from pyspark.ml.feature import Bucketizer
        s = Bucketizer(splits=[float("-inf")] + cuts + [float("inf")], inputCol="s", outputCol="_bk") \
            .setHandleInvalid("keep").transform(s)
    else:
        s = s.withColumn("_bk", F.lit(0.0))
    g = by + ["_bk"]
    per = s.groupBy(*g).agg(F.sum("c").alias("_bc"), F.sum("cp").alias("_bp"))
    wb = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("_bk") \
        .rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_c_before", F.coalesce(F.sum("_bc").over(wb), F.lit(0))) \
             .withColumn("_p_before", F.coalesce(F.sum("_bp").over(wb), F.lit(0)))
    tot = s.groupBy(*by).agg(F.sum("c").alias("_n"), F.sum("cp").alias("_P")) if by else \
        s.agg(F.sum("c").alias("_n"), F.sum("cp").alias("_P"))
    s = s.join(per, g, "inner")
    s = s.join(tot, by, "inner") if by else s.withColumn("_k", F.lit(1)).join(
        F.broadcast(tot.withColumn("_k", F.lit(1))), "_k").drop("_k")
    wi = Window.partitionBy(*g).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_below", F.col("_c_before") + F.coalesce(F.sum("c").over(wi), F.lit(0))) \
         .withColumn("_pos_below", F.col("_p_before") + F.coalesce(F.sum("cp").over(wi), F.lit(0)))
    s = s.withColumn("_mid", F.col("_below") + (F.col("c") + 1) / 2.0) \
         .withColumn("_cum_tp", F.col("_P") - F.col("_pos_below")) \
         .withColumn("_cum_n", F.col("_n") - F.col("_below"))
    r = s.groupBy(*by).agg(
        F.sum("cp").alias("P"), F.sum(F.col("c") - F.col("cp")).alias("N"),
        F.sum(F.col("cp") * F.col("_mid")).alias("_rank_sum"),
        F.sum(F.col("cp") * (F.col("_cum_tp") / F.col("_cum_n"))).alias("_ap_num"))
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0),
                 (F.col("_rank_sum") - F.col("P") * (F.col("P") + 1) / 2.0) / (F.col("P") * F.col("N")))
    ap = F.when(F.col("P") > 0, F.col("_ap_num") / F.col("P"))
    return r.select(*by, round_to(auc, 6).alias("roc_auc"), round_to(ap, 6).alias("average_precision"))


def conservation_error(df: DataFrame, by: list[str], predicted_total: str, income: str) -> DataFrame:
    """Mean |sum of predicted allocations - income|."""
    return df.groupBy(*by).agg(round_to(F.avg(F.abs(F.col(predicted_total) - F.col(income))), 6)
                               .alias("conservation_error"))


def fold_mean(df: DataFrame, model: str, metric: str) -> DataFrame:
    """Mean metric per candidate over folds."""
    return df.groupBy(model).agg(round_to(F.avg(metric), 6).alias(f"cv_{metric}"))


def select_best(df: DataFrame, model: str, key) -> DataFrame:
    """The candidate with the largest ``key`` (a column or struct)."""
    return df.agg(F.max_by(F.col(model), key).alias("best_model"))


def leaderboard_gap(a: DataFrame, b: DataFrame, model: str, metric: str) -> DataFrame:
    """J11 + T7: align two evaluations by model, gap column, sorted by it."""
    x = a.select(model, F.col(metric).alias(f"{metric}_a"))
    y = b.select(model, F.col(metric).alias(f"{metric}_b"))
    j = x.join(y, model, "full_outer")
    return j.withColumn("gap", round_to(F.col(f"{metric}_a") - F.col(f"{metric}_b"), 6)) \
            .orderBy(F.col("gap").desc_nulls_last(), model)
