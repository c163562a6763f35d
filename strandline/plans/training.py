"""Classifier training: the training table, the split, the network, its evaluation and its use on scenes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.validation import accuracy, confusion_matrix

#: Names of models by mission and colour of the sand.
SAND_COLOURS = ("default", "dark", "bright", "latest")


def training_rows(spark: SparkSession, folder: str, sites: list[str]) -> DataFrame:
    """class, features of all sites below folder (Parquet, partitioned by site); sites without rows are left out."""
    rows = spark.read.schema("site string, class string, features array<double>").parquet(folder)
    return rows.where(F.col("site").isin(*sites)).select("class", "features")


def united(tables: list[DataFrame]) -> DataFrame:
    """Training rows of several sources."""
    return reduce(DataFrame.unionByName, tables)


def training_table(df: DataFrame, label: str, features: str, keep: list[str] = ()) -> DataFrame:
    """keep, label, features as a vector; NULL and NaN in it are 1e-9. Rows without features have no vector."""
    filled = F.transform(features, lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(1e-9)), F.lit(1e-9)))
    vector = F.when(F.col(features).isNotNull(), array_to_vector(filled))
    return df.select(*keep, F.col(label).cast("double").alias("label"), vector.alias("features"))


def _fit(table: DataFrame, layers: list[int], seed: int) -> MultilayerPerceptronClassificationModel:
    return MultilayerPerceptronClassifier(layers=layers, seed=seed, maxIter=100).fit(table)


def trained(table: DataFrame, layers: list[int], seed: int = 1, share: float = 0.7) -> tuple[MultilayerPerceptronClassificationModel, DataFrame]:
    """The network and the confusion matrix on the held-out rest."""
    model, predicted = trained_and_tested(table, layers, seed, share)
    return model, confusion_matrix(predicted, "label", "prediction")


def trained_and_tested(table: DataFrame, layers: list[int], seed: int = 1, share: float = 0.7) -> tuple[MultilayerPerceptronClassificationModel, DataFrame]:
    """The network and the predictions on the held-out rest."""
    train, test = table.randomSplit([share, 1 - share], seed)
    model = _fit(train, layers, seed)
    return model, model.transform(test)


def cross_validated(table: DataFrame, layers: list[int], folds: int = 10, seed: int = 1) -> list[tuple[int, float]]:
    """(rows, accuracy) of each fold by a network fitted on the others. Folds are dealt by a hash of the features."""
    dealt = table.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), F.col("features").cast("string")), F.lit(folds)))
    out = []
    for k in range(folds):
        model = _fit(dealt.where(F.col("_fold") != k), layers, seed)
        out.append(tuple(accuracy(model.transform(dealt.where(F.col("_fold") == k)), "label", "prediction").first()))
    return out


def model_name(satname: str, colour: str = "default") -> str:
    """The folder of a mission's model: one for each colour of sand for Landsat, one for Sentinel-2."""
    if colour not in SAND_COLOURS:
        raise ValueError(f"unknown colour of sand {colour}")
    return "network_S2" if satname == "S2" else f"network_landsat_{colour}"


def loaded(folder: str, satname: str, colour: str = "default") -> MultilayerPerceptronClassificationModel:
    return MultilayerPerceptronClassificationModel.load(f"{folder}/{model_name(satname, colour)}")


def predictor(model: MultilayerPerceptronClassificationModel) -> Callable[[np.ndarray], np.ndarray]:
    """The network's forward pass as a function of an array of features, for scenes.classified: sigmoid layers, the last by its largest."""
    layers, flat, at, planes = list(model.getLayers()), model.weights.toArray(), 0, []
    for size, following in zip(layers, layers[1:], strict=False):
        w = flat[at : at + size * following].reshape(size, following)
        planes.append((w, flat[at + size * following : at + (size + 1) * following]))
        at += (size + 1) * following

    def predict(x: np.ndarray) -> np.ndarray:
        for k, (w, b) in enumerate(planes):
            x = x @ w + b
            if k < len(planes) - 1:
                x = 1 / (1 + np.exp(-np.clip(x, -700, 700)))
        return x.argmax(1)

    return predict
