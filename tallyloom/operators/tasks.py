"""Labels from a task description: predicates, a trigger, and windows around it.

A task is a dict (as read from YAML or JSON)::

    predicates: name -> {"code": "X"} | {"code": {"regex": "..."}} | {"code": {"any": [...]}} | {"expr": "or(a, b)"}
                       with optional "value_min", "value_max"
    trigger:    name
    windows:    name -> {"start": point, "end": point, "start_inclusive": bool, "end_inclusive": bool,
                         "has": {predicate: "(least, most)"}, "label": predicate, "index_timestamp": "start" | "end"}

A point is null (the record's begin or end), ``trigger``, ``other.start``, ``other.end``,
``start`` or ``end`` (of the same window), any of these ``+`` or ``-`` a duration, or
``point -> predicate`` (the next one after it) and ``point <- predicate`` (the last before it).
``_ANY_EVENT`` is a predicate that every row with time meets.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.asof import count_until, latest_before, next_after
from tallyloom.schema import parse_window

ANY = "_ANY_EVENT"


def _flag(name: str, predicates: dict[str, Any], seen: tuple[str, ...] = ()) -> Column:
    if name == ANY:
        return F.lit(True)
    if name not in predicates or name in seen:
        raise ValueError(f"unknown or circular predicate {name!r}")
    p = predicates[name]
    if "expr" in p:
        m = re.fullmatch(r"\s*(or|and)\s*\((.*)\)\s*", p["expr"])
        if not m:
            raise ValueError(f"can't read {p['expr']!r}")
        flags = [_flag(x.strip(), predicates, (*seen, name)) for x in m[2].split(",")]
        out = flags[0]
        for f in flags[1:]:
            out = (out | f) if m[1] == "or" else (out & f)
        return out
    code = p["code"]
    if isinstance(code, dict):
        out = F.col("code").rlike(code["regex"]) if "regex" in code else F.col("code").isin(list(code["any"]))
    else:
        out = F.col("code") == code
    if p.get("value_min") is not None:
        out = out & (F.col("numeric_value") >= p["value_min"])
    if p.get("value_max") is not None:
        out = out & (F.col("numeric_value") <= p["value_max"])
    return F.coalesce(out, F.lit(False))


def _bounds(text: str) -> tuple[int | None, int | None]:
    low, high = (x.strip() for x in str(text).strip().strip("()[]").split(","))
    number = lambda x: None if x in ("None", "null", "") else int(x)
    return number(low), number(high)


def extract_labels(observations: DataFrame, task: dict[str, Any]) -> DataFrame:
    """The task's label rows: subject_id, prediction_time, boolean_value (null if the task has no label).

    One row per occurrence of the trigger (rows at one time are one occurrence) whose windows all
    exist and meet their constraints. A window whose start or end can't be found doesn't exist.
    """
    predicates, windows = task.get("predicates", {}), task["windows"]
    events = observations.where("subject_id is not null and time is not null and code is not null").select("subject_id", "time", "code", "numeric_value")
    where = lambda name: events.where(_flag(name, predicates)).select("subject_id", "time")
    rows = where(task["trigger"]).distinct().withColumnRenamed("time", "trigger")
    done: set[str] = {"trigger"}
    open_points: dict[str, bool] = {}

    def resolve(rows: DataFrame, window: str, side: str) -> DataFrame:
        """Rows with the column ``<window>.<side>``."""
        name = f"{window}.{side}"
        if name in done:
            return rows
        point = windows[window].get(side)
        if point is None:
            done.add(name)
            open_points[name] = True
            return rows.withColumn(name, F.lit(None).cast("timestamp_ntz"))
        m = re.fullmatch(r"\s*([\w.]+)\s*(?:(->|<-)\s*(\w+)|([+\-])\s*([\w .]+))?\s*", str(point))
        if not m:
            raise ValueError(f"can't read the point {point!r}")
        base = f"{window}.{m[1]}" if m[1] in ("start", "end") else m[1]
        if base != "trigger":
            owner, _, end = base.rpartition(".")
            if owner not in windows or end not in ("start", "end") or base == name:
                raise ValueError(f"unknown point {m[1]!r}")
            rows = resolve(rows, owner, end)
        if m[2]:
            find = next_after if m[2] == "->" else latest_before
            others = [F.col(f"`{c}`").alias(c.replace(".", "\1")) for c in rows.columns if c != base]
            found = find(rows.select(*others, F.col(f"`{base}`").alias("_at")), where(m[3]), "_at", strict=True)
            found = found.withColumnRenamed("event_time", name).withColumnRenamed("_at", base)
            for c in found.columns:
                found = found.withColumnRenamed(c, c.replace("\1", "."))
            rows = found
        else:
            length = F.lit(0) if not m[4] else F.lit(parse_window(m[5]) * (1 if m[4] == "+" else -1))
            rows = rows.withColumn(name, F.timestamp_add("MICROSECOND", length.cast("long"), F.col(f"`{base}`")))
        done.add(name)
        return rows

    for w in windows:
        for side in ("start", "end"):
            rows = resolve(rows, w, side)
    for name in done - set(open_points) - {"trigger"}:
        rows = rows.where(F.col(f"`{name}`").isNotNull())
    # Names with dots are awkward to carry through joins.
    for w in windows:
        rows = rows.withColumnRenamed(f"{w}.start", f"{w}__start").withColumnRenamed(f"{w}.end", f"{w}__end")

    def counted(rows: DataFrame, w: str, predicate: str) -> DataFrame:
        spec, kind = windows[w], where(predicate)
        ends = {"start": spec.get("start_inclusive", True), "end": spec.get("end_inclusive", True)}
        if spec.get("end") is None:
            # Open to the end: everything up to the latest time there is.
            rows = rows.withColumn("_end", F.lit("9999-12-31").cast("timestamp_ntz"))
        else:
            rows = rows.withColumn("_end", F.col(f"{w}__end"))
        rows = count_until(rows, kind, "_end", "_upto", strict=not ends["end"]).drop("_end")
        if spec.get("start") is None:
            return rows.withColumn("_n", F.col("_upto")).drop("_upto")
        rows = count_until(rows.withColumn("_start", F.col(f"{w}__start")), kind, "_start", "_before", strict=ends["start"]).drop("_start")
        return rows.withColumn("_n", F.greatest(F.col("_upto") - F.col("_before"), F.lit(0))).drop("_upto", "_before")

    label, index = F.lit(None).cast("boolean"), F.col("trigger")
    for w, spec in windows.items():
        for predicate, text in (spec.get("has") or {}).items():
            low, high = _bounds(text)
            rows = counted(rows, w, predicate)
            if low is not None:
                rows = rows.where(F.col("_n") >= low)
            if high is not None:
                rows = rows.where(F.col("_n") <= high)
            rows = rows.drop("_n")
        if spec.get("label"):
            rows = counted(rows, w, spec["label"]).withColumn("_label", F.col("_n") > 0).drop("_n")
            label = F.col("_label")
        if spec.get("index_timestamp"):
            index = F.col(f"{w}__{spec['index_timestamp']}")
    return rows.select("subject_id", index.alias("prediction_time"), label.alias("boolean_value"))
