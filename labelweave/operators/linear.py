"""Weighted sums of a vector's entries, row by row."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import SparkSession


def linear_stage(weights: np.ndarray, intercepts: np.ndarray, source: str, output: str) -> LogisticRegressionModel:
    """A stage that adds the vector ``weights @ source + intercepts``: the raw predictions of a linear model."""
    rows, width = weights.shape
    sc = SparkSession.active().sparkContext
    # Column by column, so that an entry of a sparse vector meets its weights side by side.
    matrix = _py2java(sc, DenseMatrix(rows, width, weights.ravel(order="F")))
    java = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        f"linear{output}", matrix, _py2java(sc, Vectors.dense(intercepts)), rows, True
    )
    found = LogisticRegressionModel(java)
    found.setFeaturesCol(source).setRawPredictionCol(output)
    return found.setProbabilityCol("").setPredictionCol("")
