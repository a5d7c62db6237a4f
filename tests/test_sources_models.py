"""Sources/sinks (S1, S2, S7, S8, S9), generators (S14-S16) and model
operators (L8-L10, S10, U7) on small inputs."""

import os
import tempfile

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from centime.operators import iforest as IF
from centime.operators import ledger as L
from centime.operators import metrics as MT
from centime.operators import models as MD
from centime.operators import scoring as SC
from centime.operators import stats as ST
from centime.plans import unify_queries as UQ
from centime.sources import adapters as AD
from centime.sources import generators as G
from centime.sources.tables import Ledger

from conftest import SMALL


def test_csv_directory_unify_matches_in_memory(spark):
    db = Ledger(spark, SMALL)
    d = tempfile.mkdtemp(prefix="centime-raw-")
    raws = {"a_finance.csv": UQ.raw_finance(db), "b_household.csv": UQ.raw_household(db), "c_toy.csv": UQ.raw_toy(db)}
    for name, df in raws.items():
        AD.write_table(df.drop("record_id"), os.path.join(d, name), fmt="csv")
    # a folder of part files per name; list the parts as the source files
    files_dir = tempfile.mkdtemp(prefix="centime-csv-")
    for name in raws:
        part = [p for p in os.listdir(os.path.join(d, name)) if p.endswith(".csv")][0]
        os.link(os.path.join(d, name, part), os.path.join(files_dir, name))
    with open(os.path.join(files_dir, "z_unknown.csv"), "w") as f:
        f.write("foo,bar\n1,2\n")
    flagged, skipped = AD.load_and_unify(spark, files_dir, {"finance_8000": db.category_map()})
    assert [os.path.basename(s) for s in skipped] == ["z_unknown.csv"]
    got = flagged.filter("kept").groupBy("source", "category").count()
    want = UQ.unified_table(spark, SMALL).groupBy("source", "category").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    rep = {r["source"]: r for r in AD.unify_report(flagged).collect()}
    assert rep["finance_8000"]["dropped"] > 0  # 'promo' rows are unmapped


def test_csv_record_ids_are_file_and_position(spark):
    d = tempfile.mkdtemp(prefix="centime-csv-")
    n = {"a.csv": 4000, "b.csv": 1, "c.csv": 0}
    for name, rows in n.items():
        with open(os.path.join(d, name), "w") as f:
            f.write("expense_id,amount,merchant,description,category\n")
            f.writelines(f",{i}.0,m{i},{name},food\n" for i in range(1, rows + 1))
    open(os.path.join(d, "empty.csv"), "w").close()
    want = sorted((f"{name}:{i}", f"m{i}", name) for name, rows in n.items() for i in range(1, rows + 1))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("7k", "1m"):  # many splits a file, then one
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            flagged, skipped = AD.load_and_unify(spark, d)
            assert [os.path.basename(s) for s in skipped] == ["empty.csv"]
            assert sorted(map(tuple, flagged.select("record_id", "merchant", "description").collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_files_of_one_header_are_one_scan(spark):
    d = tempfile.mkdtemp(prefix="centime-csv-")
    for i in range(20):
        with open(os.path.join(d, f"f{i}.csv"), "w") as f:
            f.write(f"expense_id,amount,merchant,description,category\n{i},1.0,m,d,food\n")
    flagged, _ = AD.load_and_unify(spark, d)
    assert flagged.count() == 20
    assert "Union" not in flagged._jdf.queryExecution().optimizedPlan().toString()


def test_csv_directory_without_a_known_source(spark):
    d = tempfile.mkdtemp(prefix="centime-csv-")
    with open(os.path.join(d, "x.csv"), "w") as f:
        f.write("foo,bar\n1,2\n")
    with pytest.raises(ValueError):
        AD.load_and_unify(spark, d)


def test_point_lookup_edges(spark):
    asked = spark.createDataFrame([(1, 10), (1, 10), (2, 10), (None, 10), (3, None)], "user_id long, account_id long")
    have = spark.createDataFrame([(1, 10, "CURRENT", "x"), (None, 10, "SAVINGS", "x")],
                                 "user_id long, account_id long, type string, n_requests string")
    got = L.point_lookup(asked, have, ["user_id", "account_id"], ["type"])
    assert sorted(map(str, map(tuple, got.select("user_id", "account_id", "n_requests", "found", "type").collect()))) == sorted(map(str, [
        (1, 10, 2, True, "CURRENT"), (2, 10, 1, False, None), (None, 10, 1, False, None), (3, None, 1, False, None)]))
    assert L.point_lookup(asked.limit(0), have, ["user_id", "account_id"], ["type"]).count() == 0


def test_metrics_sink_roundtrip(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="centime-m-"), "metrics")
    m = spark.createDataFrame([("nb", 0.9)], "model string, macro_f1 double")
    AD.write_metrics(m, out)
    assert spark.read.json(out).first()["macro_f1"] == 0.9


def test_generators_shapes(spark):
    f = G.fraud_dataset(spark, 2000, 0.035, 42)
    assert f.count() == 2000 and f.filter("is_fraud = 1").count() == 70
    p = G.user_profiles(spark, 500, 42)
    r = p.agg(F.min("monthly_income"), F.max("monthly_income"), F.max("debt_to_income_ratio")).first()
    assert r[0] >= 15000 and r[1] <= 400000 and r[2] <= 0.5
    s = p.select(sum(F.col(f"hist_ratio_{c}") for c in ["food", "shopping", "transport", "entertainment",
                                                         "bills", "healthcare", "education"]).alias("t"))
    assert s.agg(F.min("t"), F.max("t")).first()[0] > 0.999999
    acc = Ledger(spark, SMALL).accounts().limit(3)
    seed = G.ledger_seed(spark, acc, "1998-03-15 12:00:00")
    per_day = seed.groupBy("account_id", F.to_date("date")).count().agg(F.min("count"), F.max("count")).first()
    assert per_day[0] >= 1 and per_day[1] <= 3 and seed.select(F.to_date("date")).distinct().count() == 91


def test_fraud_classifiers_and_vote(spark):
    data = G.fraud_dataset(spark, 3000, 0.05, 7).withColumn("label", F.col("is_fraud").cast("double"))
    data = data.withColumn("weight", F.when(F.col("is_fraud") == 1, 19.0).otherwise(1.0))
    feats = SC.fraud_features(data, with_velocity=False)
    cols = ["amount", "amount_to_category_ratio", "hour_of_day", "is_night_time", "distance_from_home_km",
            "trust_clipped", "merchant_risk_clipped", "velocity_1h", "is_foreign_currency"]
    v = VectorAssembler(inputCols=cols, outputCol="features").transform(feats)
    v = ST.hash_folds(v, ["id"], 5, 42)
    tr, te = v.filter("fold <> 0"), v.filter("fold = 0")
    rf = MD.fraud_classifier("rf").setNumTrees(30).fit(tr).transform(te)
    gbt = MD.fraud_classifier("gbt").setMaxIter(20).fit(tr).transform(te)
    vote = MD.soft_vote([rf, gbt], "id", ["0", "1"], [0.6, 0.4])
    lab = te.select("id", "label")
    scored = vote.join(lab, "id").select(F.col("label").cast("int").alias("label"),
                                         F.when(F.col("predicted_category") == "1", F.col("confidence"))
                                         .otherwise(1 - F.col("confidence")).alias("score"))
    r = MT.ranking_metrics(scored, []).first()
    assert r["roc_auc"] > 0.9
    forest = IF.fit(feats, cols, "id", n_trees=50, sample_size=128, seed=1)
    s = IF.flag_outliers(IF.score(feats, forest, cols), 0.05)
    rate = s.filter("is_outlier").count() / s.count()
    assert 0.03 < rate < 0.08
    assert s.groupBy("is_fraud").agg(F.avg("anomaly_score")).orderBy("is_fraud").collect()[1][1] > \
        s.groupBy("is_fraud").agg(F.avg("anomaly_score")).orderBy("is_fraud").collect()[0][1]


def test_hash_folds_and_model_persistence(spark):
    f = ST.hash_folds(spark.range(1000), ["id"], 5, 42)
    counts = [r[1] for r in f.groupBy("fold").count().orderBy("fold").collect()]
    assert len(counts) == 5 and sum(counts) == 1000 and min(counts) > 150
    p = G.user_profiles(spark, 300, 3).withColumn("y", F.col("monthly_income") * 0.2)
    m = MD.regression_pipeline(["monthly_income", "savings_target_pct"], ["lifestyle"], "ridge").fit(p)
    path = os.path.join(tempfile.mkdtemp(prefix="centime-model-"), "ridge")
    MD.save_model(m, path)
    again = MD.load_model(path).transform(p).select("prediction").collect()
    assert len(again) == 300
