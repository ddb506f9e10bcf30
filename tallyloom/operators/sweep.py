"""Hyper-parameter trials: seeded search, logs, ranking, what is kept."""

from __future__ import annotations

import hashlib
import json
import math
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.schema import TRIALS
from tallyloom.workspace import copy, delete, exists, folders, write_text


def sample_trials(space: dict[str, Any], n: int, seed: int) -> list[dict[str, Any]]:
    """``n`` seeded draws: lists are choices, (low, high) pairs are ranges, ("log", low, high) ranges on a log scale, whole if both ends are, and anything else is fixed."""
    rng = random.Random(seed)

    def draw(v: Any) -> Any:
        if isinstance(v, list):
            return rng.choice(v)
        if isinstance(v, tuple) and len(v) == 3 and v[0] == "log":
            x = math.exp(rng.uniform(math.log(v[1]), math.log(v[2])))
            return round(x) if all(isinstance(e, int) for e in v[1:]) else x
        if isinstance(v, tuple) and len(v) == 2:
            return rng.randint(*v) if all(isinstance(x, int) for x in v) else rng.uniform(*v)
        return v

    return [{k: draw(v) for k, v in sorted(space.items())} for _ in range(n)]


def trial_name(params: dict[str, Any]) -> str:
    """A name that is the same for the same parameters, in every process."""
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]


def run_sweep(spark: SparkSession, trials: Sequence[dict[str, Any]], run: Callable[[dict[str, Any], str], tuple[float, float]], folder: str, threads: int = 2) -> None:
    """Run each trial in a folder of its own and log its parameters and (tuning, test) AUC there.

    ``folder`` lies in any file system that Spark writes to. The same parameters drawn twice are one trial.
    """

    def one(params: dict[str, Any]) -> None:
        name = trial_name(params)
        place = f"{folder}/{name}"
        write_text(spark, f"{place}/config.json", json.dumps(params, sort_keys=True, default=str))
        tuning, test = run(params, place)
        write_text(spark, f"{place}/performance.log", f"trial_name,tuning_auc,test_auc\n{name},{tuning},{test}\n")

    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(one, {trial_name(t): t for t in trials}.values()))


def read_trials(spark: SparkSession, folder: str) -> DataFrame:
    """The logs of all trials of a sweep."""
    return spark.read.schema(TRIALS).option("header", True).csv(f"{folder}/*/*performance.log")


def rank_trials(trials: DataFrame, k: int | None = None) -> DataFrame:
    """Trials by falling tuning AUC, missing ones last, of equal ones by name; the first ``k`` if asked."""
    ranked = trials.orderBy(F.desc_nulls_last("tuning_auc"), "trial_name")
    return ranked if k is None else ranked.limit(k)


def keep_best(spark: SparkSession, trials: DataFrame, folder: str, k: int) -> list[str]:
    """Delete the folders of all trials below the ``k`` best; the names of those kept, best first.

    Only folders directly below ``folder`` that hold a performance log are ever deleted.
    """
    kept = [r["trial_name"] for r in rank_trials(trials, k).collect()]
    for name in folders(spark, folder):
        if name not in kept and exists(spark, f"{folder}/{name}/performance.log"):
            delete(spark, f"{folder}/{name}")
    return kept


def finish_sweep(spark: SparkSession, folder: str, k: int) -> str | None:
    """Rank, write the summary, keep the best ``k`` and copy the best, with its model and predictions, to ``best_trial``; its name."""
    delete(spark, f"{folder}/best_trial")
    trials = read_trials(spark, folder)
    rows = rank_trials(trials).collect()
    summary = spark.createDataFrame([tuple(r) for r in rows], TRIALS)
    summary.coalesce(1).write.mode("overwrite").parquet(f"{folder}/sweep_results_summary.parquet")
    kept = keep_best(spark, summary, folder, k)
    if not kept:
        return None
    copy(spark, f"{folder}/{kept[0]}", f"{folder}/best_trial")
    return kept[0]
