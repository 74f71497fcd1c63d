"""k-means buckets of a vector feature, with an optional PCA, and their index."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import uniform


def fit(rows: DataFrame, feature: str, k: int, key: str, dims: int | None = None, share: float = 1.0, seed: int = 0) -> PipelineModel:
    """Fitted on a share of the rows, chosen by hash of the key; the same steps are used to predict."""
    some = rows if share >= 1 else rows.where(uniform(F.col(key), seed) < share)
    vectors = some.where(F.col(feature).isNotNull()).select(array_to_vector(F.col(feature).cast("array<double>")).alias("_v"))
    steps = [PCA(k=dims, inputCol="_v", outputCol="_p")] if dims else []
    steps.append(KMeans(k=k, seed=seed, featuresCol="_p" if dims else "_v", predictionCol="cluster"))
    return Pipeline(stages=steps).fit(vectors)


def assign(rows: DataFrame, model: PipelineModel, feature: str) -> DataFrame:
    """Adds cluster."""
    with_vector = rows.where(F.col(feature).isNotNull()).withColumn("_v", array_to_vector(F.col(feature).cast("array<double>")))
    return model.transform(with_vector).drop("_v", "_p")


def index(assigned: DataFrame, key: str) -> DataFrame:
    return assigned.select(F.lit("cluster").alias("feature"), F.col("cluster").cast("string").alias("value"), F.col(key).alias("key"))
