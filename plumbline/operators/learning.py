"""Reviewer patterns learned from labelled records."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, IndexToString, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import functions as P
from plumbline import schema as S
from plumbline.operators.risk import FEATURES

CATEGORIES = ["crop_name", "calamity_type", "district", "tehsil"]
FOLDS = 5


def ml_features(df: DataFrame, features: DataFrame) -> DataFrame:
    """``df`` with the numeric features (by pos), categories in lower case, the
    order of our confidence and the numbers of flags. Label columns are not read."""
    out = df.select("pos", "surveyor_name", *CATEGORIES, *[c for c in ("AI_Confidence", "AI_Flags", "Data_QC_Flags") if c in df.columns])
    out = out.join(features.select("pos", *[F.col(c).cast("double").alias(c) for c in FEATURES]), "pos")
    cats = {c: F.coalesce(F.lower(F.trim(c)), F.lit("na")) for c in CATEGORIES}
    size = lambda c: F.size(F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda x: F.trim(x) != "")).cast("double")
    extra = {"ai_confidence": F.when(F.col("AI_Confidence") == "Low", 0.0).when(F.col("AI_Confidence") == "Medium", 1.0).when(F.col("AI_Confidence") == "High", 2.0) if "AI_Confidence" in df.columns else F.lit(None).cast("double")}
    extra |= {n: size(c) if c in df.columns else F.lit(None).cast("double") for n, c in (("ai_flag_count", "AI_Flags"), ("data_flag_count", "Data_QC_Flags"))}
    return out.withColumns(cats | extra)


def _pipeline(kind: str, numeric: list[str]) -> Pipeline:
    stages = [
        Imputer(inputCols=numeric, outputCols=[f"{c}_i" for c in numeric], strategy="median"),
        *[StringIndexer(inputCol=c, outputCol=f"{c}_x", handleInvalid="keep") for c in CATEGORIES],
        OneHotEncoder(inputCols=[f"{c}_x" for c in CATEGORIES], outputCols=[f"{c}_v" for c in CATEGORIES], handleInvalid="keep"),
        VectorAssembler(inputCols=[f"{c}_i" for c in numeric] + [f"{c}_v" for c in CATEGORIES], outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="_x"),
    ]
    model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=100, regParam=1e-3) if kind == "logreg" else RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=60, maxDepth=8, seed=0, maxBins=64)
    return Pipeline(stages=[*stages, model])


def train(df: DataFrame, label: str, least: int = S.MIN_LABELLED) -> tuple[PipelineModel, dict] | None:
    """The better of two models by macro F1 over folds that keep a surveyor
    together, fitted on all labelled rows, and its report; None with fewer than
    ``least`` labels or fewer than two classes of five rows."""
    rows = df.withColumn("_label", P.clean_label(label)).filter("_label is not null")
    counts = rows.groupBy("_label").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 5")
    sizes = {r["_label"]: r["_n"] for r in counts.collect()}  # one row a class
    total = sum(sizes.values())
    if total < least or len(sizes) < 2:
        return None
    indexer = StringIndexer(inputCol="_label", outputCol="_y").fit(rows.join(F.broadcast(counts.select("_label")), "_label"))
    rows = indexer.transform(rows.join(F.broadcast(counts), "_label")).withColumn("_w", F.lit(total / len(sizes)) / F.col("_n"))
    numeric = [c for c in [*FEATURES, "ai_confidence", "ai_flag_count", "data_flag_count"] if c in df.columns]
    held = rows.agg(*[F.count(c).alias(c) for c in numeric]).first()
    numeric = [c for c in numeric if held[c]]
    rows = rows.withColumn("_fold", P.hash_bucket(F.coalesce("surveyor_name", F.lit("")), FOLDS)).cache()
    score = MulticlassClassificationEvaluator(labelCol="_y", predictionCol="prediction", metricName="f1")
    results = {}
    for kind in ("forest", "logreg"):
        parts = [_pipeline(kind, numeric).fit(rows.filter(F.col("_fold") != k)).transform(rows.filter(F.col("_fold") == k)) for k in range(FOLDS) if not rows.filter(F.col("_fold") == k).isEmpty()]
        results[kind] = sum(map(score.evaluate, parts)) / len(parts)
    best = max(results, key=results.get)
    fitted = _pipeline(best, numeric).fit(rows)
    names = IndexToString(inputCol="prediction", outputCol=f"ML_{label}", labels=indexer.labels)
    rows.unpersist()
    return PipelineModel([*fitted.stages, names]), {"chosen": best, "f1": results, "rows": total, "baseline": max(sizes.values()) / total, "classes": indexer.labels}


def predict(model: PipelineModel, df: DataFrame, label: str) -> DataFrame:
    """(pos, ML_label, ML_label_Conf)."""
    out = model.transform(df)
    return out.select("pos", f"ML_{label}", F.bround(F.array_max(vector_to_array("probability")), 3).alias(f"ML_{label}_Conf"))
