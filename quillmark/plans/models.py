"""Trained models (section P) on pyspark.ml: fixed seeds, held-out measures as rows.

Names begin with ml_; their numbers are those of the models here, not of other libraries' checkpoints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, StandardScaler, Tokenizer
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.ml.stat import Summarizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators.changes import bugs
from quillmark.sources.tables import materialize, table

GIT = ["code_churn", "author_count", "file_age_days", "n_past_bugs", "commit_freq", "n_files", "entropy", "lines_added", "lines_deleted", "is_fix", "developer_exp"]


def labelled(spark, sf_dir) -> DataFrame:
    """id, label, features (vector), weight, is_test (by hash of the repo, so that repos stay whole)."""
    b = bugs(spark, sf_dir).where("label is not null and size(features) = 16")
    git = [F.coalesce(F.col(f"git.{g}"), F.lit(0.0)) for g in GIT]
    vec = F.concat(F.transform("features", lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))), F.array(*git))
    return b.select("id", F.col("label").cast("double").alias("label"), array_to_vector(vec).alias("features"), F.coalesce("weight", F.lit(1.0)).alias("weight"), (F.pmod(F.xxhash64("repo"), F.lit(5)) == 0).alias("is_test"))


def _row(spark, name: str, metric: str, value: float, n: int) -> DataFrame:
    return spark.createDataFrame([(name, metric, round(float(value), 6), n)], "model string, metric string, value double, n_test long")


def held_out_auc(spark, sf_dir, name: str, stages: list) -> DataFrame:
    d = materialize(labelled(spark, sf_dir), "labelled")
    model = Pipeline(stages=stages).fit(d.where("not is_test"))
    test = model.transform(d.where("is_test"))
    return _row(spark, name, "auc", BinaryClassificationEvaluator().evaluate(test), test.count())


def _scale() -> StandardScaler:
    return StandardScaler(inputCol="features", outputCol="scaled", withMean=True)


def ml_logistic(spark, sf_dir):
    """P.1, P.4, P.17: weighted logistic regression."""
    return held_out_auc(spark, sf_dir, "logistic", [_scale(), LogisticRegression(featuresCol="scaled", weightCol="weight", maxIter=50, regParam=0.01)])


def ml_boosted(spark, sf_dir):
    """P.2, P.5: boosted trees."""
    return held_out_auc(spark, sf_dir, "boosted", [GBTClassifier(maxIter=20, maxDepth=4, weightCol="weight", seed=7)])


def ml_forest(spark, sf_dir):
    """P.9, P.11: random forest."""
    return held_out_auc(spark, sf_dir, "forest", [RandomForestClassifier(numTrees=50, maxDepth=8, seed=7)])


def ml_perceptron(spark, sf_dir):
    """P.3, P.15: multilayer perceptron."""
    return held_out_auc(spark, sf_dir, "perceptron", [_scale(), MultilayerPerceptronClassifier(featuresCol="scaled", layers=[27, 16, 2], maxIter=60, seed=7)])


def ml_complexity(spark, sf_dir):
    """P.5-P.8: boosted regression of the complexity target, its error, and residual quantiles for bounds."""
    t = table(spark, sf_dir, "complexity_dataset").where("target between 0 and 100 and size(features) = 16")
    d = materialize(t.select(F.col("target").alias("label"), array_to_vector("features").alias("features"), (F.pmod(F.xxhash64("origin"), F.lit(5)) == 0).alias("is_test")), "complexity")
    m = GBTRegressor(maxIter=20, maxDepth=4, seed=7).fit(d.where("not is_test"))
    p = m.transform(d.where("is_test")).withColumn("e", F.col("label") - F.col("prediction"))
    return p.agg(F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 6).alias("rmse"), F.round(F.percentile("e", F.lit(0.25)), 6).alias("lower"), F.round(F.percentile("e", F.lit(0.75)), 6).alias("upper"), F.count(F.lit(1)).alias("n_test"))


def ml_importances(spark, sf_dir):
    """P.6, H.29: importances of a forest's features, greatest first."""
    d = labelled(spark, sf_dir).where("not is_test")
    m = RandomForestClassifier(numTrees=30, maxDepth=6, seed=7).fit(d)
    names = [f"static_{i}" for i in range(16)] + GIT
    return spark.createDataFrame([(n, round(float(v), 6)) for n, v in zip(names, m.featureImportances.toArray())], "feature string, importance double")


def ml_text_security(spark, sf_dir):
    """P.9, P.14, E.27: security label from hashed TF-IDF of the source's tokens."""
    s = table(spark, sf_dir, "security_dataset").where("label is not null and source is not null")
    s = s.select(F.regexp_replace("source", r"\W+", " ").alias("text"), F.col("label").cast("double").alias("label"), (F.pmod(F.xxhash64("origin"), F.lit(5)) == 0).alias("is_test"))
    stages = [Tokenizer(inputCol="text", outputCol="t"), HashingTF(inputCol="t", outputCol="tf", numFeatures=1 << 12), IDF(inputCol="tf", outputCol="features"), LogisticRegression(maxIter=30, regParam=0.05)]
    d = materialize(s, "security_text")
    test = Pipeline(stages=stages).fit(d.where("not is_test")).transform(d.where("is_test"))
    return _row(spark, "text_security", "auc", BinaryClassificationEvaluator().evaluate(test), test.count())


def ml_isotonic(spark, sf_dir):
    """P.13, P.21: calibration error before and after isotonic regression of the logistic score."""
    d = materialize(labelled(spark, sf_dir), "labelled")
    lr = Pipeline(stages=[_scale(), LogisticRegression(featuresCol="scaled", maxIter=50)]).fit(d.where("not is_test"))
    p = lr.transform(d).select("label", "is_test", vector_to_array("probability")[1].alias("p"))
    iso = IsotonicRegression(featuresCol="p", labelCol="label").fit(p.where("not is_test"))
    q = iso.transform(p.where("is_test"))
    both = q.select("label", F.explode(F.array(F.struct(F.lit("raw").alias("kind"), F.col("p").alias("v")), F.struct(F.lit("isotonic").alias("kind"), F.col("prediction").alias("v")))).alias("x")).select("label", "x.*")
    b = both.groupBy("kind", F.least(F.lit(9), F.floor(F.col("v") * 10)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("label") - F.avg("v")).alias("gap"))
    return b.groupBy("kind").agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"))


def ml_out_of_distribution(spark, sf_dir):
    """N.1, O.33: Mahalanobis distance of each record from the mean; the unit is the 68th percentile.  Only the
    mean and the covariance (27 by 27) reach the driver."""
    d = labelled(spark, sf_dir)
    cols = [f"x{i}" for i in range(27)]
    x = d.select("id", vector_to_array("features").alias("v"))
    n, mean = x.select(F.count(F.lit(1)), Summarizer.mean(array_to_vector("v"))).first()
    mu = np.array(mean.toArray())
    sums = x.select(*(F.col("v")[i].alias(c) for i, c in enumerate(cols))).agg(*(F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i in range(27) for j in range(i, 27))).first()
    cov = np.zeros((27, 27))
    for i in range(27):
        for j in range(i, 27):
            cov[i, j] = cov[j, i] = sums[f"c{i}_{j}"] or 0.0
    inv = np.linalg.inv(cov + 1e-6 * np.eye(27))

    def run(parts):
        for part in parts:
            c = np.array(part.v.tolist()).reshape(-1, 27) - mu
            yield part.assign(distance=np.sqrt(np.maximum(0, np.einsum("ij,jk,ik->i", c, inv, c))))[["id", "distance"]]

    dist = x.mapInPandas(run, "id long, distance double")
    unit = F.broadcast(dist.agg(F.percentile_approx("distance", F.lit(0.68), 10000).alias("unit")))
    return dist.join(unit).select("id", F.round("distance", 5).alias("distance"), F.round(F.col("distance") / F.col("unit"), 5).alias("sigma"))


def min_norm_weights(grads: np.ndarray, steps: int = 50) -> np.ndarray:
    """P.19: Frank-Wolfe weights (a point of the simplex) that minimise the norm of the weighted gradient sum."""
    g = grads @ grads.T
    w = np.full(len(g), 1 / len(g))
    for _ in range(steps):
        i = int(np.argmin(g @ w))
        e = np.eye(len(g))[i]
        d = e - w
        den = d @ g @ d
        if den <= 1e-12:
            break
        w = w + min(1.0, max(0.0, -(w @ g @ d) / den)) * d
    return w


def ml_bootstrap(spark, sf_dir, resamples: int = 200, seed: int = 7):
    """J.9, P.23: bootstrap interval of the label rate; each row draws a Poisson(1) count per resample by the hash of its id,
    so the resamples cost one pass and are independent of how rows are partitioned.  A task returns one row a resample."""
    b = bugs(spark, sf_dir).where("label is not null").select("id", F.col("label").cast("double").alias("label"))
    edges = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120)])
    salts = np.random.default_rng(seed).integers(1, 2**63, size=resamples, dtype=np.uint64)

    def draw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hits = np.zeros(resamples), np.zeros(resamples)
        for part in parts:
            ids = part.column("id").to_numpy().astype(np.uint64)
            y = part.column("label").to_numpy()
            for at in range(0, len(ids), 4096):
                h = (ids[at : at + 4096, None] ^ salts) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                k = np.searchsorted(edges, ((h ^ (h >> np.uint64(32))) >> np.uint64(11)) / 2.0**53, side="right")
                total += k.sum(axis=0)
                hits += y[at : at + 4096] @ k
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(total), pa.array(hits)], names=["s", "n", "pos"])

    g = b.mapInArrow(draw, "s long, n double, pos double").groupBy("s").agg(F.try_divide(F.sum("pos"), F.sum("n")).alias("rate"))
    return g.agg(F.round(F.percentile("rate", F.lit(0.025)), 6).alias("low"), F.round(F.avg("rate"), 6).alias("mean"), F.round(F.percentile("rate", F.lit(0.975)), 6).alias("high"))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("ml_")}
