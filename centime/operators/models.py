"""Model operators on Spark ML.

Featurisation is a Spark ML pipeline (word n-gram hashing TF-IDF plus
one-hot calendar/amount-bucket columns); estimators are Spark ML's
(complement naive Bayes, weighted logistic regression, random forest,
gradient-boosted trees).  Class balancing is a ``weightCol``; cross
validation uses an explicit ``foldCol`` from the exact stratified folds.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, NaiveBayes,
                                       RandomForestClassifier)
from pyspark.ml.feature import (HashingTF, IDF, IndexToString, OneHotEncoder, StandardScaler,
                                StringIndexer, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from ..functions import dims
from ..functions.dates import day_of_week
from ..functions.text import text_feature
from . import text_features as TF


def categoriser_inputs(df: DataFrame) -> DataFrame:
    """Model inputs of a unified transaction: word 1-3-grams of the text
    feature, day of week, amount bucket (if present)."""
    d = df.withColumn("text_feature", text_feature("merchant", "description")) \
          .withColumn("day_of_week", day_of_week("date").cast("string"))
    d = d.withColumn("_tok", TF.word_tokens("text_feature"))
    return d.withColumn("grams", TF.word_ngrams(F.col("_tok"), 1, 3)).drop("_tok")


def categoriser_features(num_features: int = 1 << 18, label: str = "category") -> list:
    """L1/L2/L4 stages shared by every categoriser candidate."""
    return [
        StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc"),
        HashingTF(inputCol="grams", outputCol="tf", numFeatures=num_features),
        IDF(inputCol="tf", outputCol="tfidf"),
        StringIndexer(inputCols=["day_of_week", "amount_bucket"], outputCols=["dow_i", "bucket_i"],
                      handleInvalid="keep"),
        OneHotEncoder(inputCols=["dow_i", "bucket_i"], outputCols=["dow_v", "bucket_v"], dropLast=False,
                      handleInvalid="keep"),
        VectorAssembler(inputCols=["tfidf", "dow_v", "bucket_v"], outputCol="features"),
    ]


def categoriser_estimator(model: str, n_train: int = 1000):
    """L6 candidates on the shared features."""
    if model == "nb":
        return NaiveBayes(modelType="complement", weightCol="weight")
    if model == "lr":
        return LogisticRegression(maxIter=30, regParam=1.0 / (3.0 * max(n_train, 1)), weightCol="weight",
                                  family="multinomial")
    if model == "rf":
        return RandomForestClassifier(numTrees=20, maxDepth=10, weightCol="weight", seed=42,
                                      featureSubsetStrategy="sqrt")
    raise ValueError(model)


def categoriser_pipeline(model: str = "nb", num_features: int = 1 << 18, label: str = "category",
                         n_train: int = 1000) -> Pipeline:
    """TF-IDF of n-grams + one-hot columns + one estimator.

    model: 'nb' (complement naive Bayes), 'lr' (logistic regression,
    C = 3 -> regParam 1/(3 n), class-weighted), 'rf' (random forest,
    class-weighted), 'gbt' (one-vs-rest gradient-boosted trees is expensive
    and not built here; use 'rf').
    """
    return Pipeline(stages=categoriser_features(num_features, label) + [categoriser_estimator(model, n_train)])


def predict_category(model, df: DataFrame, threshold: float = dims.LOW_CONFIDENCE,
                     labels: list[str] | None = None) -> DataFrame:
    """Predicted class, its probability and a low-confidence flag."""
    labels = labels or model.stages[0].labels
    p = model.transform(df)
    p = IndexToString(inputCol="prediction", outputCol="predicted_category", labels=labels).transform(p)
    conf = F.array_max(vector_to_array("probability"))
    return p.withColumn("confidence", conf).withColumn("low_confidence", F.col("confidence") < threshold)


def soft_vote(preds: list[DataFrame], key: str, labels: list[str], weights: list[float] | None = None) -> DataFrame:
    """Weighted average of the candidates' probability vectors."""
    w = weights or [1.0 / len(preds)] * len(preds)
    base = None
    for i, p in enumerate(preds):
        a = p.select(key, vector_to_array("probability").alias(f"_p{i}"))
        base = a if base is None else base.join(a, key)
    arrs = [F.transform(F.col(f"_p{i}"), _scale(wi)) for i, wi in enumerate(w)]
    tot = arrs[0]
    for a in arrs[1:]:
        tot = F.zip_with(tot, a, lambda x, y: x + y)
    lab = F.array(*[F.lit(x) for x in labels])
    out = base.select(key, tot.alias("probability"))
    best = F.array_position(F.col("probability"), F.array_max("probability"))
    return out.select(key, F.element_at(lab, best.cast("int")).alias("predicted_category"),
                      F.array_max("probability").alias("confidence"))


def _scale(wi: float):
    def f(x):
        return x * wi
    return f


def save_model(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline (one folder per candidate)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# ------------------------------------------------------------ regressors ---

def regressor(kind: str, features: str = "features", label: str = "y"):
    """Ridge (LinearRegression, elasticNet 0), random forest, GBT."""
    if kind == "ridge":
        return LinearRegression(featuresCol=features, labelCol=label, regParam=1.0, elasticNetParam=0.0)
    if kind == "rf":
        return RandomForestRegressor(featuresCol=features, labelCol=label, numTrees=50, maxDepth=10, seed=42)
    if kind == "gbt":
        return GBTRegressor(featuresCol=features, labelCol=label, maxIter=30, maxDepth=5, stepSize=0.1, seed=42)
    raise ValueError(kind)


def regression_pipeline(num_cols: list[str], cat_cols: list[str], kind: str, label: str = "y") -> Pipeline:
    """L2/L3 + estimator: one-hot categoricals, standardised numerics."""
    stages = []
    vec_in = []
    if cat_cols:
        stages += [StringIndexer(inputCols=cat_cols, outputCols=[f"{c}_i" for c in cat_cols], handleInvalid="keep"),
                   OneHotEncoder(inputCols=[f"{c}_i" for c in cat_cols], outputCols=[f"{c}_v" for c in cat_cols],
                                 dropLast=False, handleInvalid="keep")]
        vec_in += [f"{c}_v" for c in cat_cols]
    stages += [VectorAssembler(inputCols=num_cols, outputCol="_num", handleInvalid="keep"),
               StandardScaler(inputCol="_num", outputCol="_nums", withMean=True, withStd=True)]
    vec_in = ["_nums"] + vec_in
    stages += [VectorAssembler(inputCols=vec_in, outputCol="features"), regressor(kind, label=label)]
    return Pipeline(stages=stages)


def fraud_classifier(kind: str, features: str = "features", label: str = "label", weight: str = "weight"):
    """Random forest (200 trees, depth 12) or boosted trees (depth 5,
    step 0.06), positives up-weighted through ``weightCol``."""
    if kind == "rf":
        return RandomForestClassifier(featuresCol=features, labelCol=label, weightCol=weight,
                                      numTrees=200, maxDepth=12, seed=42)
    if kind == "gbt":
        return GBTClassifier(featuresCol=features, labelCol=label, weightCol=weight, maxIter=200,
                             maxDepth=5, stepSize=0.06, seed=42)
    raise ValueError(kind)
