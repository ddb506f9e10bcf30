"""Command line: python -m tallyloom.cli STAGE name=value ...

Stages: describe, tabularize, cache-task, model, sweep, subsets. Parameters are those of
``TabConfig``; ``model`` and ``sweep`` also take ``model=NAME``, ``sweep`` ``trials=N`` and
``keep=K``; ``subsets`` takes the items themselves. A stage whose output is complete is skipped
unless ``overwrite=true``.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import assemble, describe, features, models, prep, rolling, selection, static, subsets, sweep, task
from tallyloom.schema import ROLLING_AGGS, STATIC_AGGS, TabConfig
from tallyloom.sources.sinks import finished, read_features, write_features, write_table
from tallyloom.sources.tables import read_labels, read_observations
from tallyloom.workspace import staged


#: What a sweep draws from for every model: how often a feature must occur, and how cells are scaled. Imputing makes the matrix dense, so it is asked for, not drawn.
PREPARING = {"min_code_count": ("log", 1, 1000), "scaler": [None, "standard", "max_abs"]}
#: What a sweep draws from for each model, besides.
SPACES = {
    "logistic_regression": {"regParam": ("log", 1e-4, 1.0)},
    "sgd": {"regParam": ("log", 1e-4, 0.1), "elasticNetParam": (0.0, 1.0)},
    "random_forest": {"numTrees": (10, 60), "maxDepth": (2, 10), "scaler": None},
    "gradient_boosting": {"maxIter": (5, 30), "maxDepth": (2, 6), "stepSize": ("log", 0.01, 0.3), "scaler": None},
    "knn": {"k": (1, 20), "weights": ["uniform", "distance"], "p": [1, 2]},
}


class Stages:
    """The stages of a run; all paths are derived here, below ``output_dir``."""

    def __init__(self, spark: SparkSession, config: TabConfig) -> None:
        if not config.input_dir or not config.output_dir:
            raise ValueError("input_dir and output_dir are needed")
        self.spark, self.c = spark, config
        self.frequencies_path = f"{config.output_dir}/metadata/frequencies"
        self.selected_path = f"{config.output_dir}/metadata/selected"
        self.features_path = f"{config.output_dir}/tabularize"
        self.labels_path = f"{config.output_dir}/task/labels"
        self.cache_path = f"{config.output_dir}/task/features"
        self.models_path = f"{config.output_dir}/models"

    def _write(self, df: DataFrame, path: str, partition_by=()) -> None:
        write_table(df, path, overwrite=self.c.overwrite, skip_if_exists=True, partition_by=partition_by)

    def observations(self) -> DataFrame:
        return read_observations(self.spark, self.c.input_dir)

    def describe(self) -> None:
        """Code frequencies of all splits, or of ``describe_splits``."""
        rows = self.observations()
        if self.c.describe_splits:
            rows = rows.where(F.col("split").isin(list(self.c.describe_splits)))
        self._write(describe.code_frequencies(rows), self.frequencies_path)

    def selected(self) -> DataFrame:
        """The selected features, chosen once and written beside the frequencies, never over them."""
        if self.c.overwrite or not finished(self.spark, self.selected_path):
            chosen = features.select_features(
                self.spark.read.parquet(self.frequencies_path), self.c.allowed_codes, self.c.min_code_count, self.c.min_code_frequency, self.c.max_codes
            )
            write_table(chosen.coalesce(1), self.selected_path, overwrite=True)
        return self.spark.read.parquet(self.selected_path)

    def tabularize(self) -> None:
        """Static and rolling features of every index row, or of the labels' rows, as one long table."""
        if not self.c.overwrite and finished(self.spark, self.features_path):
            return
        selected = self.selected()
        features.selected_names(selected)
        rows = self.observations()
        kept = features.drop_rare(rows, selected)
        splits = rows.select("subject_id", "split").where("subject_id is not null").groupBy("subject_id").agg(F.min("split").alias("split"))
        events = features.events_of(kept, selected)
        index = features.event_index(events)
        rolled, facts = [a for a in self.c.aggs if a in ROLLING_AGGS], [a for a in self.c.aggs if a in STATIC_AGGS]
        if self.c.label_dir:
            labels = read_labels(self.spark, self.c.label_dir).select("subject_id", "time").distinct()
            labels = task.labels_of_known_subjects(labels, index)
            parts = [rolling.melt(task.label_features(labels, events, self.c.windows, rolled), rolled)] if rolled else []
            index = labels
        else:
            parts = [rolling.melt(rolling.rolling_features(index, events, self.c.windows, rolled), rolled)] if rolled else []
        for agg in facts:
            cells = static.static_first(kept) if agg == "static/first" else static.static_present(kept).withColumn("value", F.lit(1.0))
            cells = cells.select("subject_id", "code", "value")
            parts.append(index.join(cells, "subject_id").select("subject_id", "time", F.lit(None).cast("string").alias("window"), F.lit(agg).alias("agg"), "code", "value"))
        table = parts[0]
        for p in parts[1:]:
            table = table.unionByName(p)
        # The table itself says whose times it is keyed by, for the stages that read it.
        time = F.col("time").alias("time", metadata={"rows": "labels" if self.c.label_dir else "events"})
        write_features(table.join(splits, "subject_id").withColumn("time", time), self.features_path, overwrite=self.c.overwrite)

    def cache_task(self) -> None:
        """Labels aligned with index rows, and the cells of those rows."""
        selected = self.selected()
        events = features.events_of(features.drop_rare(self.observations(), selected), selected)
        labels = task.first_labels(read_labels(self.spark, self.c.label_dir, order="_order"), ["_order"]).drop("_order")
        aligned = task.align_labels(labels.select("subject_id", "time", "label"), features.event_index(events))
        splits = self.observations().where("subject_id is not null").groupBy("subject_id").agg(F.min("split").alias("split"))
        self._write(aligned.join(splits, "subject_id"), self.labels_path, ["split"])
        cells = read_features(self.spark, self.features_path)
        if self.c.overwrite or not finished(self.spark, self.cache_path):
            keyed_by = cells.schema["time"].metadata.get("rows")
            if keyed_by is None:
                raise ValueError(f"{self.features_path} doesn't say whether its rows are events or labels: tabularize again with overwrite=true")
            aligned = self.spark.read.parquet(self.labels_path)
            write_features(task.gather_rows(aligned, cells.drop("split"), keyed_by == "labels").join(splits, "subject_id"), self.cache_path, overwrite=self.c.overwrite)

    def matrix(self, windows: Sequence[str], aggs: Sequence[str], min_code_count: int | None = None, scaler: str | None = None) -> DataFrame | None:
        """Labels with their vectors; None if no feature is left.

        Selection by count and by correlation, imputing and scaling, in this order, are fitted on train alone.
        """
        scaler = scaler or self.c.scaler
        try:
            names = features.selected_names(features.select_features(self.selected(), min_count=min_code_count))
        except ValueError:
            return None
        columns = assemble.column_table(names, windows, aggs)
        labels = task.binarized(self.spark.read.parquet(self.labels_path))
        cells = read_features(self.spark, self.cache_path, windows, aggs)
        train = labels.where("split = 'train'")
        if self.c.min_correlation is not None or self.c.max_by_correlation is not None:
            found = selection.label_correlation(train, cells.where("split = 'train'").drop("split"))
            if self.c.min_correlation is not None:
                found = found.join(selection.select_min_correlation(found, self.c.min_correlation), "code", "left_semi")
            if self.c.max_by_correlation is not None:
                found = found.join(selection.select_max_by_correlation(found, self.c.max_by_correlation), "code", "left_semi")
            kept = {r[0] for r in found.select("code").distinct().collect()}
            columns = [(i, *c[1:]) for i, c in enumerate(c for c in columns if c[3] in kept)]
            cells = cells.where(F.col("code").isin(list(kept)))
        if not columns:
            return None
        of_train = cells.where("split = 'train'").drop("split")
        cells = cells.drop("split")
        if self.c.imputer:
            cells, of_train = prep.impute(labels, cells, self.c.imputer, fit_on=of_train), prep.impute(train, of_train, self.c.imputer)
        if scaler == "standard":
            cells = prep.standard_scale(cells, train.count(), of_train)
        elif scaler == "max_abs":
            cells = prep.max_abs_scale(cells, of_train)
        return assemble.sparse_vectors(labels, cells, columns)

    def _prepared(self) -> dict:
        """What of selection, imputing and scaling is asked for."""
        return {k: v for k in ("min_correlation", "max_by_correlation", "imputer", "scaler") if (v := getattr(self.c, k)) is not None}

    @staticmethod
    def _write_predictions(model: models.TabularModel, rows: DataFrame, place: str) -> None:
        for split in ("tuning", "held_out"):
            write_table(models.predictions(model.scores(rows.where(F.col("split") == split))), f"{place}/{split}_predictions", overwrite=True)

    def sweep(self, name: str = "logistic_regression", trials: int = 10, keep: int = 3, threads: int = 2) -> str | None:
        """Seeded trials over subsets of windows and aggregations and the model's parameters; the best one's name."""
        space = PREPARING | SPACES[name] | {"windows": subsets.non_empty_subsets(self.c.windows), "aggs": subsets.non_empty_subsets(self.c.aggs)}

        def run(params: dict, place: str) -> tuple[float, float]:
            own = {k: v for k, v in params.items() if k not in ("windows", "aggs", *PREPARING)}
            rows = self.matrix(params["windows"], params["aggs"], params["min_code_count"], params["scaler"])
            if rows is None:
                return 0.0, 0.0
            rows = staged(rows, "matrix")
            model = models.make_model(name, self.c.seed, **own)
            model.train(rows.where("split = 'train'"), rows.where("split = 'tuning'"))
            model.save(f"{place}/model")
            self._write_predictions(model, rows, place)
            return model.evaluate(rows.where("split = 'tuning'")), model.evaluate(rows.where("split = 'held_out'"))

        folder = f"{self.c.output_dir}/sweep"
        sweep.run_sweep(self.spark, sweep.sample_trials(space, trials, self.c.seed), run, folder, threads)
        return sweep.finish_sweep(self.spark, folder, keep)

    def model(self, name: str = "logistic_regression", **params) -> float:
        """Train on train, score tuning, write predictions of tuning and held_out; the tuning AUC, 0.0 without features."""
        rows = self.matrix(self.c.windows, self.c.aggs)
        if rows is None:
            return 0.0
        rows = staged(rows, "matrix")
        model = models.make_model(name, self.c.seed, **params)
        model.train(rows.where("split = 'train'"), rows.where("split = 'tuning'"))
        place = f"{self.models_path}/{sweep.trial_name({'model': name, 'seed': self.c.seed, **self._prepared(), **params})}"
        model.save(f"{place}/model")
        self._write_predictions(model, rows, place)
        return model.evaluate(rows.where("split = 'tuning'"))


def main(args: list[str]) -> None:
    if not args or args[0] not in ("describe", "tabularize", "cache-task", "model", "sweep", "subsets"):
        sys.exit(__doc__)
    stage, rest = args[0], args[1:]
    if stage == "subsets":
        print(subsets.as_choices(subsets.non_empty_subsets(rest)))
        return
    own = {k: v for k, _, v in (x.partition("=") for x in rest) if k in ("model", "trials", "keep")}
    config = TabConfig().with_overrides([x for x in rest if x.partition("=")[0] not in own])
    spark = SparkSession.builder.appName(f"tallyloom-{stage}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run = Stages(spark, config)
    name = own.get("model", "logistic_regression")
    if stage == "model":
        print(f"tuning AUC {run.model(name):.4f}")
    elif stage == "sweep":
        print(f"best trial {run.sweep(name, int(own.get('trials', 10)), int(own.get('keep', 3)))}")
    else:
        getattr(run, stage.replace("-", "_"))()


if __name__ == "__main__":
    main(sys.argv[1:])
