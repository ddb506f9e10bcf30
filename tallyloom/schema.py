"""Tables of the engine, their column types, and the closed list of aggregations."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "time": T.TimestampNTZType()}


def _table(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


OBSERVATIONS = _table(subject_id="long", time="time", code="string", numeric_value="double")
FREQUENCIES = _table(code="string", count="long")
LABELS = _table(subject_id="long", prediction_time="time", boolean_value="boolean")
PREDICTIONS = _table(
    subject_id="long", prediction_time="time", boolean_value="boolean", predicted_boolean_value="boolean", predicted_boolean_probability="double", event_id="long"
)
TRIALS = _table(trial_name="string", tuning_auc="double", test_auc="double")
FEATURES = _table(subject_id="long", time="time", window="string", agg="string", code="string", value="double")

STATIC_AGGS = ("static/present", "static/first")
CODE_AGGS = ("code/count",)
VALUE_AGGS = ("value/count", "value/sum", "value/sum_sqd", "value/min", "value/max")
ROLLING_AGGS = CODE_AGGS + VALUE_AGGS
AGGREGATIONS = STATIC_AGGS + ROLLING_AGGS
#: What each aggregation reads: the kind that ends the name of its features.
KINDS = ("code", "value", "static/present", "static/first")

_UNITS = {
    "w": 604_800_000_000, "week": 604_800_000_000, "weeks": 604_800_000_000, "d": 86_400_000_000, "day": 86_400_000_000, "days": 86_400_000_000,
    "h": 3_600_000_000, "hr": 3_600_000_000, "hour": 3_600_000_000, "hours": 3_600_000_000, "min": 60_000_000, "m": 60_000_000, "minute": 60_000_000, "minutes": 60_000_000,
    "s": 1_000_000, "sec": 1_000_000, "second": 1_000_000, "seconds": 1_000_000, "ms": 1_000, "us": 1,
}


def parse_window(size: str) -> int | None:
    """Microseconds of a window such as ``7d``, ``12h`` or ``1d 6h``; None for ``full``, the whole history."""
    text = size.strip().lower()
    if text == "full":
        return None
    parts = re.findall(r"([\d.]+)\s*([a-z]+)", text)
    if not parts or re.sub(r"[\d.]+\s*[a-z]+[\s,]*", "", text) or any(u not in _UNITS for _, u in parts):
        raise ValueError(f"not a window: {size!r}")
    total = round(sum(float(n) * _UNITS[u] for n, u in parts))
    if total <= 0:
        raise ValueError(f"a window must be positive: {size!r}")
    return total


def kind_of(agg: str) -> str:
    """The kind of feature an aggregation reads; ValueError for what isn't one of ``AGGREGATIONS``."""
    if agg not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {agg!r}; known are {', '.join(AGGREGATIONS)}")
    return agg if agg in STATIC_AGGS else agg.split("/")[0]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``, cast to its types; ValueError names those that are missing."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


@dataclass(frozen=True)
class TabConfig:
    """Parameters of a tabularization run; see the command line for their use."""

    input_dir: str = ""
    output_dir: str = ""
    label_dir: str | None = None
    windows: tuple[str, ...] = ("1d", "7d", "30d", "365d", "full")
    aggs: tuple[str, ...] = AGGREGATIONS
    min_code_count: int | None = None
    min_code_frequency: float | None = None
    max_codes: int | None = None
    allowed_codes: tuple[str, ...] | None = None
    describe_splits: tuple[str, ...] | None = None
    min_correlation: float | None = None
    max_by_correlation: int | None = None
    imputer: str | None = None
    scaler: str | None = None
    overwrite: bool = False
    seed: int = 1

    def with_overrides(self, pairs: list[str]) -> TabConfig:
        """A copy with ``name=value`` overrides; lists are written ``[a,b]``."""
        values = {f: getattr(self, f) for f in self.__dataclass_fields__}
        for pair in pairs:
            name, _, text = pair.partition("=")
            if name not in values:
                raise ValueError(f"unknown parameter {name!r}")
            if text in ("null", "None", ""):
                values[name] = None
            elif text.startswith("["):
                values[name] = tuple(x.strip().strip("'\"") for x in text[1:-1].split(",") if x.strip())
            elif name in ("min_code_count", "max_codes", "max_by_correlation", "seed"):
                values[name] = int(text)
            elif name in ("min_code_frequency", "min_correlation"):
                values[name] = float(text)
            elif name == "overwrite":
                values[name] = text.lower() == "true"
            elif isinstance(values[name], tuple):
                values[name] = (text,)
            else:
                values[name] = text
        config = TabConfig(**values)
        if config.imputer not in (None, "mean", "median", "mode") or config.scaler not in (None, "standard", "max_abs"):
            raise ValueError("imputer is mean, median or mode, scaler is standard or max_abs")
        for a in config.aggs or ():
            kind_of(a)
        for w in config.windows or ():
            parse_window(w)
        return config
