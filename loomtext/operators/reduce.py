"""Reduced vectors by principal components."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.vector import dot


def reduce_vectors(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """((_ref, vec, vec_reduced), components: (component, explained_variance_ratio, loadings)) of (_ref, vec). Vectors are
    centred; each component's sign makes its largest loading positive. The covariance is added up in the cluster; the
    driver holds dim x dim numbers."""
    d = vectors.select("_ref", "vec", array_to_vector("vec").alias("raw"))
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="centred").fit(d)
    model = PCA(k=k, inputCol="centred", outputCol="_").fit(scaler.transform(d))
    pc = model.pc.toArray()
    pc = pc * np.sign(pc[np.abs(pc).argmax(axis=0), np.arange(pc.shape[1])])
    mean = scaler.mean.toArray()
    centred = F.zip_with("vec", F.array(*[F.lit(float(x)) for x in mean]), lambda a, b: a - b)
    reduced = F.array(*[dot(F.col("c"), F.array(*[F.lit(float(x)) for x in pc[:, i]])) for i in range(pc.shape[1])])
    out = vectors.withColumn("c", centred).withColumn("vec_reduced", reduced).drop("c")
    ratios = model.explainedVariance.toArray()
    rows = [(i, float(ratios[i]), [float(x) for x in pc[:, i]]) for i in range(pc.shape[1])]
    return out, vectors.sparkSession.createDataFrame(rows, "component int, explained_variance_ratio double, loadings array<double>")
