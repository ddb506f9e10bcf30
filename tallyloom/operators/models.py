"""Baseline models over feature vectors: a registry on Spark ML, training, scoring, storing."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any, Protocol

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.metrics import auc_value
from tallyloom.operators.neighbours import knn_of_points
from tallyloom.operators.ordering import number_rows
from tallyloom.schema import PREDICTIONS, conform
from tallyloom.workspace import staged


class TabularModel(Protocol):
    """What a trial needs of a model."""

    def train(self, data: DataFrame) -> None: ...

    def evaluate(self, data: DataFrame) -> float: ...

    def save(self, path: str) -> None: ...


def _logistic(seed: int, **params: Any) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label", **({"regParam": 0.01, "elasticNetParam": 0.0, "maxIter": 50} | params))


#: Models by name. Gradient boosting and trees see absent cells as 0; ``sgd`` is the elastic-net logistic loss.
MODELS: dict[str, Callable[..., Any]] = {
    "logistic_regression": _logistic,
    "sgd": lambda seed, **p: _logistic(seed, **({"regParam": 0.001, "elasticNetParam": 0.15} | p)),
    "random_forest": lambda seed, **p: RandomForestClassifier(
        featuresCol="features", labelCol="label", seed=seed, **({"numTrees": 50, "maxDepth": 8, "featureSubsetStrategy": "sqrt"} | p)
    ),
    "gradient_boosting": lambda seed, **p: GBTClassifier(featuresCol="features", labelCol="label", seed=seed, **({"maxIter": 20, "maxDepth": 4} | p)),
}


class NeighbourModel:
    """The k nearest neighbours of a row as a model; its training rows are its state."""

    def __init__(self, **params: Any) -> None:
        self.params = {"k": 5, "weights": "uniform", "p": 2} | params
        self.rows: DataFrame | None = None

    def train(self, data: DataFrame, validation: DataFrame | None = None) -> None:
        kept = data.select(F.col("label").cast("int").alias("y"), vector_to_array("features").alias("x"))
        self.rows = staged(kept.where("y is not null"), "neighbours")

    def scores(self, data: DataFrame) -> DataFrame:
        """The rows with ``score``, the share of positive labels among the nearest training rows."""
        if self.rows is None:
            raise ValueError("the model isn't trained")
        asked = number_rows(data, ["subject_id", "time"], "q")
        found = knn_of_points(self.rows, asked.select("q", vector_to_array("features").alias("x")), **self.params)
        return asked.join(found, "q", "left").drop("q")

    def evaluate(self, data: DataFrame) -> float:
        return auc_value(self.scores(data))

    def save(self, path: str) -> None:
        if self.rows is None:
            raise ValueError("the model isn't trained")
        self.rows.withColumn("y", F.col("y").alias("y", metadata={"params": json.dumps(self.params)})).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NeighbourModel:
        rows = spark.read.parquet(path)
        model = cls(**json.loads(rows.schema["y"].metadata["params"]))
        model.rows = rows.select("y", "x")
        return model


def make_model(name: str, seed: int = 1, **params: Any) -> TabularModel:
    """A model by its name: one of ``MODELS`` or ``knn``."""
    return NeighbourModel(**params) if name == "knn" else SparkTabularModel(name, seed, **params)


class SparkTabularModel:
    """A registered model: trains on rows of (features, label), scores, saves, loads."""

    def __init__(self, name: str, seed: int = 1, **params: Any) -> None:
        if name not in MODELS:
            raise ValueError(f"unknown model {name!r}; known are {', '.join(MODELS)}")
        self.name, self.stage = name, MODELS[name](seed, **params)
        self.fitted: Model | None = None

    def train(self, data: DataFrame, validation: DataFrame | None = None) -> None:
        """Fit; with ``validation`` boosting stops once it no longer improves there."""
        rows = data.select("features", F.col("label").cast("double").alias("label")).where("label is not null")
        stage = self.stage
        if validation is not None and self.name == "gradient_boosting":
            held = validation.select("features", F.col("label").cast("double").alias("label"), F.lit(True).alias("_held")).where("label is not null")
            rows = rows.withColumn("_held", F.lit(False)).unionByName(held)
            stage = stage.copy({stage.validationIndicatorCol: "_held"})
        self.fitted = Pipeline(stages=[stage]).fit(rows)

    def scores(self, data: DataFrame) -> DataFrame:
        """The rows with ``score``, the probability of the positive class."""
        if self.fitted is None:
            raise ValueError("the model isn't trained")
        out = self.fitted.transform(data.withColumn("label", F.col("label").cast("double")))
        return out.withColumn("score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")

    def evaluate(self, data: DataFrame) -> float:
        return auc_value(self.scores(data))

    def save(self, path: str) -> None:
        if self.fitted is None:
            raise ValueError("the model isn't trained")
        self.fitted.write().overwrite().save(path)

    @classmethod
    def load(cls, name: str, path: str) -> SparkTabularModel:
        model = cls(name)
        model.fitted = PipelineModel.load(path)
        return model


def predictions(scored: DataFrame) -> DataFrame:
    """The prediction table of scored label rows (subject_id, time, label, event_id, score)."""
    named = scored.select(
        "subject_id", F.col("time").alias("prediction_time"), (F.col("label") > 0).alias("boolean_value"), (F.bround("score") > 0).alias("predicted_boolean_value"),
        F.col("score").alias("predicted_boolean_probability"), "event_id",
    )
    return conform(named, PREDICTIONS)
