"""Queries of the tabularization operators, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.names import bare_code
from tallyloom.operators import assemble, describe, encode, features, metrics, models, neighbours, prep, rolling, selection, static, subsets, sweep, task, tasks
from tallyloom.operators.ordering import number_rows
from tallyloom.plans.tabular_sql import SQL  # noqa: F401
from tallyloom.schema import ROLLING_AGGS
from tallyloom.sources import tables
from tallyloom.workspace import staged

WINDOWS = ("2h", "12h", "1d", "7d", "30d", "365d", "full")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
#: Aggregations of the matrices that queries assemble.
AGGS = ("code/count", "value/sum")
#: Two example tasks.
TASKS = {
    "repeat_purchase": {
        "predicates": {"purchase": {"code": "purchase"}, "look": {"code": {"regex": "^(view|click)$"}}, "any": {"expr": "or(purchase, look)"}},
        "trigger": "purchase",
        "windows": {
            "input": {"start": None, "end": "trigger + 1d", "has": {"look": "(2, None)"}, "index_timestamp": "end"},
            "target": {"start": "input.end", "end": "start + 7d", "start_inclusive": False, "label": "purchase"},
        },
    },
    "next_visit": {
        "predicates": {"purchase": {"code": "purchase"}, "view": {"code": "view"}},
        "trigger": "purchase",
        "windows": {"gap": {"start": "trigger", "end": "start -> view", "start_inclusive": False, "has": {"purchase": "(None, 1)"}, "label": "purchase", "index_timestamp": "end"}},
    },
}


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return tables.observations_of_events(spark, folder)


def _shipments(spark: SparkSession, folder: str) -> DataFrame:
    return tables.observations_of_shipments(spark, folder)


def _measured(spark: SparkSession, folder: str) -> DataFrame:
    return tables.observations_of_measurements(spark, folder)


def describe_code_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return describe.code_frequencies(_measured(spark, folder))


def _select(spark: SparkSession, folder: str, **how) -> DataFrame:
    return features.select_features(describe_code_frequencies(spark, folder), **how)


def restricted_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return features.restrict_metadata(tables.table(spark, folder, "code_metadata"), _select(spark, folder, min_count=100))


def feature_positions(spark: SparkSession, folder: str) -> DataFrame:
    return features.feature_index(_select(spark, folder, min_count=20))


def filter_rare_observations(spark: SparkSession, folder: str) -> DataFrame:
    return features.drop_rare(_measured(spark, folder), _select(spark, folder, min_count=60))


def events_projection(spark: SparkSession, folder: str) -> DataFrame:
    return features.events_of(_measured(spark, folder), _select(spark, folder, min_count=60))


def unique_event_index(spark: SparkSession, folder: str) -> DataFrame:
    return features.numbered_index(features.event_index(_measured(spark, folder)))


def encoded_code_cells(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder)
    return encode.code_cells(events, features.event_index(events), describe.code_frequencies(events))


def encoded_value_cells(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder)
    return encode.value_cells(events, features.event_index(events), describe.code_frequencies(events))


def feature_indices_by_aggregation(spark: SparkSession, folder: str) -> DataFrame:
    return encode.indices_of(_select(spark, folder, min_count=20), "value/sum")


def static_first(spark: SparkSession, folder: str) -> DataFrame:
    return static.static_first(_measured(spark, folder)).withColumn("value", F.round("value", 6))


def static_present(spark: SparkSession, folder: str) -> DataFrame:
    return static.static_present(_measured(spark, folder))


def static_wide(spark: SparkSession, folder: str) -> DataFrame:
    facts = tables.statics_of_customers(spark, folder)
    return static.static_wide(facts, ["ACCTBAL"], [f"SEGMENT//{s}" for s in SEGMENTS])


def static_replicated(spark: SparkSession, folder: str) -> DataFrame:
    return static.replicate_static(features.event_index(_events(spark, folder)), static_wide(spark, folder))


def same_time_collapse(spark: SparkSession, folder: str) -> DataFrame:
    out = rolling.collapse_same_time(_shipments(spark, folder), 2)
    return out.select("subject_id", "time", "code", "n", "nv", *[F.col(c).cast("double").alias(c) for c in ("s", "ss", "lo", "hi")])


def _rolling(spark: SparkSession, folder: str, agg: str, window: str) -> DataFrame:
    events = _events(spark, folder)
    out = rolling.rolling_features(features.event_index(events), events, [window], [agg], scale=2)
    return out.where(F.col(out.columns[-1]).isNotNull())


def rolling_all(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder)
    return rolling.rolling_features(features.event_index(events), events, WINDOWS, scale=2)


def rolling_all_by_spine(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder)
    return rolling.rolling_by_spine(features.event_index(events), events, WINDOWS, scale=2)


def rolling_shipments(spark: SparkSession, folder: str) -> DataFrame:
    events = _shipments(spark, folder)
    return rolling.rolling_features(features.event_index(events), events, ["30d", "full"], scale=2)


def rolling_measurements(spark: SparkSession, folder: str, windows: Sequence[str] = ("1d",)) -> DataFrame:
    events = _measured(spark, folder).where("time is not null")
    return rolling.rolling_features(features.event_index(events), events, windows, scale=1)


def _bounds(spark: SparkSession, folder: str, window: str) -> DataFrame:
    return rolling.window_bounds(features.event_index(_events(spark, folder)), window)


def long_feature_table(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder)
    return rolling.melt(rolling.rolling_features(features.event_index(events), events, ["1d", "7d"], AGGS, scale=2), AGGS)


def label_asof_event(spark: SparkSession, folder: str) -> DataFrame:
    return task.latest_before(tables.labels_of_events(spark, folder), _events(spark, folder).select("subject_id", "time"))


def _label_windows(spark: SparkSession, folder: str, window: str, anchor: str) -> DataFrame:
    return task.label_features(tables.labels_of_events(spark, folder), _events(spark, folder), [window], scale=2, anchor=anchor)


def cache_task_labels(spark: SparkSession, folder: str) -> DataFrame:
    return task.align_labels(tables.labels_of_events(spark, folder), features.event_index(_events(spark, folder)))


def cache_task_rows(spark: SparkSession, folder: str) -> DataFrame:
    return task.gather_rows(cache_task_labels(spark, folder), long_feature_table(spark, folder))


def label_dedup_first(spark: SparkSession, folder: str) -> DataFrame:
    labels = task.rename_label_columns(tables.table(spark, folder, "task_labels"))
    return task.first_labels(labels, ["label_id"])


def labels_semi_subjects(spark: SparkSession, folder: str) -> DataFrame:
    labels = task.rename_label_columns(tables.table(spark, folder, "task_labels"))
    return task.labels_of_known_subjects(labels, features.event_index(_measured(spark, folder)))


def labels_per_class(spark: SparkSession, folder: str) -> DataFrame:
    return task.labels_per_class(task.binarized(task.rename_label_columns(tables.table(spark, folder, "task_labels"))))


def feature_columns(spark: SparkSession, folder: str) -> DataFrame:
    events = describe.code_frequencies(_events(spark, folder))
    listed = assemble.column_table(features.selected_names(events), ["1d", "full"], ["code/count", "value/sum", "value/max"])
    return spark.createDataFrame([(i, name) for i, *_, name in listed], "idx long, name string")


def _label_cells(spark: SparkSession, folder: str, windows: Sequence[str] = ("7d", "full"), aggs: Sequence[str] = AGGS) -> tuple[DataFrame, DataFrame]:
    """Labels and the long feature table of their rows."""
    labels = tables.labels_of_events(spark, folder)
    cells = rolling.melt(task.label_features(labels, _events(spark, folder), windows, aggs, scale=2, anchor="label"), aggs)
    return labels, cells


def feature_label_correlation(spark: SparkSession, folder: str) -> DataFrame:
    return selection.label_correlation(*_label_cells(spark, folder)).withColumn("r", F.round("r", 6))


def _by_correlation(spark: SparkSession, folder: str, pick, value) -> DataFrame:
    return pick(selection.label_correlation(*_label_cells(spark, folder)), value)


def _scaled(spark: SparkSession, folder: str, how: str) -> DataFrame:
    labels, cells = _label_cells(spark, folder)
    out = prep.standard_scale(cells, labels.count()) if how == "standard" else prep.max_abs_scale(cells)
    return out.select("subject_id", "time", "window", "agg", "code", F.round("value", 6).alias("value"))


def _imputed(spark: SparkSession, folder: str, strategy: str) -> DataFrame:
    labels, cells = _label_cells(spark, folder, ["7d"])
    return prep.impute(labels, cells, strategy).withColumn("value", F.round("value", 6))


def preprocessed_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells imputed and then scaled, both fitted on the labels of train."""
    labels, cells = _label_cells(spark, folder, ["7d"])
    of_train = tables.split_of_subject(F.col("subject_id")) == "train"
    train, fit = labels.where(of_train), cells.where(of_train)
    filled, filled_train = prep.impute(labels, cells, "mean", fit_on=fit), prep.impute(train, fit, "mean")
    return prep.standard_scale(filled, train.count(), filled_train).withColumn("value", F.round("value", 6))


def select_count_and_correlation(spark: SparkSession, folder: str) -> DataFrame:
    """Frequent features whose code has a column that goes with the label."""
    frequent = features.select_features(describe.code_frequencies(_events(spark, folder)), min_count=500)
    strong = selection.select_min_correlation(selection.label_correlation(*_label_cells(spark, folder)), 0.05)
    return frequent.join(strong.withColumnRenamed("code", "_bare"), bare_code(F.col("code")) == F.col("_bare"), "left_semi")


def auc_exact(spark: SparkSession, folder: str) -> DataFrame:
    labels, cells = _label_cells(spark, folder, ["7d"], ["code/count"])
    totals = cells.groupBy("subject_id", "time").agg(F.sum("value").alias("score"))
    scores = labels.join(totals, ["subject_id", "time"], "left").select("label", F.coalesce("score", F.lit(0.0)).alias("score"))
    return metrics.auc(scores).withColumn("auc", F.round("auc", 9))


def rank_trials_top_k(spark: SparkSession, folder: str) -> DataFrame:
    s = tables.table(spark, folder, "supplier")
    trials = s.select(F.col("s_name").alias("trial_name"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("tuning_auc"), F.col("s_acctbal").alias("test_auc"))
    return sweep.rank_trials(trials, 10)


def non_empty_subsets(spark: SparkSession, folder: str) -> DataFrame:
    return subsets.subsets_table(spark, [r[0] for r in tables.table(spark, folder, "region").select("r_name").orderBy("r_name").collect()])


def _task(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tasks.extract_labels(_events(spark, folder), TASKS[name])


def _matrix(spark: SparkSession, folder: str) -> tuple[DataFrame, list]:
    labels, cells = _label_cells(spark, folder)
    columns = assemble.column_table(features.selected_names(describe.code_frequencies(_events(spark, folder))), ["7d", "full"], AGGS)
    rows = number_rows(labels, ["subject_id", "time"], "event_id").withColumn("split", tables.split_of_subject(F.col("subject_id")))
    return assemble.sparse_vectors(rows, cells, columns), columns


def sparse_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = _matrix(spark, folder)
    return rows.select("subject_id", "time", "split", "label", F.expr("cast(features as string)").alias("features"))


def sparse_vector_cells(spark: SparkSession, folder: str) -> DataFrame:
    """What the vectors hold, as rows: the place of each column in them, and its value."""
    rows, _ = _matrix(spark, folder)
    cells = rows.select("subject_id", "time", F.posexplode(vector_to_array("features")).alias("idx", "value"))
    return cells.where("value <> 0").withColumn("value", F.round("value", 6))


def _model(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows, _ = _matrix(spark, folder)
    rows = staged(rows, "matrix")
    model = models.SparkTabularModel(name)
    model.train(rows.where("split = 'train'"), rows.where("split = 'tuning'"))
    return models.predictions(model.scores(rows.where("split = 'held_out'")))


def knn_predictions(spark: SparkSession, folder: str) -> DataFrame:
    labels, cells = _label_cells(spark, folder, ["7d"], ["code/count"])
    names = features.selected_names(describe.code_frequencies(_events(spark, folder)))
    columns = assemble.column_table(names, ["7d"], ["code/count"])
    rows = staged(assemble.dense_columns(number_rows(labels, ["subject_id", "time"], "row"), cells, columns), "matrix")
    split = tables.split_of_subject(F.col("subject_id"))
    scores = neighbours.knn_scores(rows.where(split == "train"), rows.where(split == "held_out"), [c[4] for c in columns], "row", k=5)
    return scores.withColumn("score", F.round("score", 9))


QUERIES = {
    "describe_code_frequencies": describe_code_frequencies,
    "select_codes_allowed": partial(_select, allowed=["VITAL//PULSE/code", "VITAL//PULSE/value", "BORN/code", "NOWHERE/code"]),
    "select_codes_min_count": partial(_select, min_count=100),
    "select_codes_min_frequency": partial(_select, min_frequency=0.004),
    "select_codes_top_k": partial(_select, max_features=25),
    "select_codes_combined": partial(_select, min_frequency=0.001, min_count=50, max_features=40),
    "restricted_metadata": restricted_metadata,
    "feature_positions": feature_positions,
    "feature_indices_by_aggregation": feature_indices_by_aggregation,
    "encoded_code_cells": encoded_code_cells,
    "encoded_value_cells": encoded_value_cells,
    "filter_rare_observations": filter_rare_observations,
    "events_projection": events_projection,
    "unique_event_index": unique_event_index,
    "static_first": static_first,
    "static_present": static_present,
    "static_wide": static_wide,
    "static_replicated": static_replicated,
    "same_time_collapse": same_time_collapse,
    **{f"rolling_{a.replace('/', '_')}_{w}": partial(_rolling, agg=a, window=w) for a in ROLLING_AGGS for w in WINDOWS},
    "rolling_all": rolling_all,
    "rolling_all_by_spine": rolling_all_by_spine,
    "rolling_shipments": rolling_shipments,
    "rolling_measurements": rolling_measurements,
    # Without SQL, whose join of rows and events is quadratic in a subject's rows; tests have it on little data.
    "rolling_measurements_full": partial(rolling_measurements, windows=("full",)),
    "rolling_measurements_all": partial(rolling_measurements, windows=WINDOWS),
    "rolling_window_bounds_7d": partial(_bounds, window="7d"),
    "rolling_window_bounds_full": partial(_bounds, window="full"),
    "long_feature_table": long_feature_table,
    "label_asof_event": label_asof_event,
    "label_window_features_7d": partial(_label_windows, window="7d", anchor="event"),
    "label_window_features_full": partial(_label_windows, window="full", anchor="event"),
    "label_window_features_own_time_7d": partial(_label_windows, window="7d", anchor="label"),
    "cache_task_labels": cache_task_labels,
    "cache_task_rows": cache_task_rows,
    "label_dedup_first": label_dedup_first,
    "labels_semi_subjects": labels_semi_subjects,
    "labels_per_class": labels_per_class,
    "feature_columns": feature_columns,
    "feature_label_correlation": feature_label_correlation,
    "select_min_correlation": partial(_by_correlation, pick=selection.select_min_correlation, value=0.05),
    "select_max_by_correlation": partial(_by_correlation, pick=selection.select_max_by_correlation, value=2),
    "scale_standard": partial(_scaled, how="standard"),
    "scale_max_abs": partial(_scaled, how="max_abs"),
    "select_count_and_correlation": select_count_and_correlation,
    "preprocessed_cells": preprocessed_cells,
    "impute_mean": partial(_imputed, strategy="mean"),
    "impute_median": partial(_imputed, strategy="median"),
    "impute_mode": partial(_imputed, strategy="mode"),
    "auc_exact": auc_exact,
    "rank_trials_top_k": rank_trials_top_k,
    "non_empty_subsets": non_empty_subsets,
    "task_labels_repeat_purchase": partial(_task, name="repeat_purchase"),
    "task_labels_next_visit": partial(_task, name="next_visit"),
    "sparse_vectors": sparse_vectors,
    "sparse_vector_cells": sparse_vector_cells,
    "model_logreg_predictions": partial(_model, name="logistic_regression"),
    "model_sgd_predictions": partial(_model, name="sgd"),
    "model_rf_predictions": partial(_model, name="random_forest"),
    "model_gbt_predictions": partial(_model, name="gradient_boosting"),
    "knn_predictions": knn_predictions,
}
