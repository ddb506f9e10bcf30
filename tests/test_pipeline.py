"""The stages from end to end on a small cohort, sources, sinks, streaming, stored coordinates."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom import cli
from tallyloom.operators import describe, encode, features
from tallyloom.schema import PREDICTIONS, TabConfig
from tallyloom.sources import sinks, tables
from tallyloom.streaming.describe import stream_frequencies

OBS = "subject_id long, time timestamp_ntz, code string, numeric_value double"
T = dt.datetime(2015, 3, 1)


def cohort(seed, subjects):
    """Subjects with a height and an eye colour, visits with repeated readings, some at one time."""
    rng = random.Random(seed)
    rows = []
    for s in subjects:
        rows += [(s, None, "HEIGHT", rng.uniform(150, 190)), (s, None, f"EYES//{rng.choice(['BROWN', 'BLUE'])}", None), (s, dt.datetime(1960, 1, 1), "BORN", None)]
        t = T + dt.timedelta(days=rng.randrange(100))
        for _ in range(rng.randrange(2, 6)):
            t += dt.timedelta(hours=rng.randrange(1, 200))
            rows += [(s, t, "ARRIVE//WARD", None), (s, t, "PULSE", float(rng.randrange(50, 120))), (s, t, "WARMTH", rng.uniform(96, 103)), (s, t, "WARMTH", rng.uniform(96, 103))]
        rows.append((s, t + dt.timedelta(hours=5), "LEAVE", None))
    return rows


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cohort")
    shards = {"train/0": range(1, 15), "train/1": range(15, 30), "tuning/0": range(30, 40), "held_out/0": range(40, 50)}
    for i, (name, subjects) in enumerate(shards.items()):
        pdf = spark.createDataFrame(cohort(i, subjects), OBS).toPandas()
        path = root / "data" / f"{name}.parquet"
        path.parent.mkdir(parents=True, exist_ok=True)
        pdf["time"] = pdf["time"].astype("datetime64[us]")
        pdf.to_parquet(path, index=False)
        labels = pdf[pdf["code"] == "WARMTH"].groupby(["subject_id", "time"], as_index=False)["numeric_value"].max()
        labels["boolean_value"] = labels.pop("numeric_value") > 101
        (root / "labels").mkdir(exist_ok=True)
        labels.rename(columns={"time": "prediction_time"}).to_parquet(root / "labels" / f"{i}.parquet", index=False)
    return root


def test_sources(spark, stored):
    for root in (str(stored / "data"), f"file://{stored}/data/"):
        shards = tables.list_shards(spark, root)
        assert list(shards) == ["held_out/0", "train/0", "train/1", "tuning/0"]
        assert spark.read.parquet(shards["train/1"]).count() > 0
    assert tables.list_shards(spark, str(stored / "nowhere")) == {} and tables.list_shards(spark, str(stored / "data"), "csv") == {}
    got = {(r.split, r.shard) for r in tables.read_observations(spark, str(stored / "data")).select("split", "shard").distinct().collect()}
    assert got == {("train", "0"), ("train", "1"), ("tuning", "0"), ("held_out", "0")}
    assert "label" in tables.read_labels(spark, str(stored / "labels")).columns
    places = [r["_place"] for r in tables.read_labels(spark, str(stored / "labels"), order="_place").collect()]
    assert len(set(places)) == len(places) and places[0].row_index == 0
    with pytest.raises(ValueError):
        tables.read_labels(spark, str(stored / "labels"), "nothing")


def test_sinks(spark, tmp_path):
    df = spark.range(3)
    path = str(tmp_path / "t")
    assert sinks.write_table(df, path)
    with pytest.raises(Exception, match="exists"):
        sinks.write_table(df, path)
    assert not sinks.write_table(df, path, skip_if_exists=True) and sinks.write_table(df.limit(1), path, overwrite=True)
    assert spark.read.parquet(path).count() == 1
    with sinks.locked(spark, path), pytest.raises(FileExistsError):
        sinks.write_table(df, path, overwrite=True)
    assert sinks.write_table(df, path, overwrite=True) and not (tmp_path / "t.lock").exists()
    with pytest.raises(TypeError):
        sinks.write_table([1], path)
    cells = spark.createDataFrame([(1, "7d", "code/count", "A", 2.0), (1, None, "static/first", "B", 0.0), (1, None, "static/present", "B", 1.0), (1, "7d", "value/sum", "A", float("nan"))], "subject_id long, window string, agg string, code string, value double")
    sinks.write_features(cells, str(tmp_path / "f"))
    back = sinks.read_features(spark, str(tmp_path / "f"), ["7d"], ["code/count", "static/present"])
    assert sorted((r.window, r.agg, r.value) for r in back.collect()) == [("7d", "code/count", 2.0), ("none", "static/present", 1.0)]


def test_windows_that_look_like_numbers(spark, tmp_path):
    rows = [(1, T, w, "code/count", "A", float(i + 1), s) for i, w in enumerate(["7d", "30d"]) for s in ("1", "02")]
    kept = F.col("time").alias("time", metadata={"rows": "events"})
    cells = spark.createDataFrame(rows, "subject_id long, time timestamp_ntz, window string, agg string, code string, value double, split string").withColumn("time", kept)
    sinks.write_features(cells, str(tmp_path / "f"))
    back = sinks.read_features(spark, str(tmp_path / "f"))
    assert {(r.window, r.agg, r.split, r.time, r.value) for r in back.collect()} == {(w, a, s, t, v) for _, t, w, a, _, v, s in rows}
    assert back.schema["time"].metadata == {"rows": "events"}
    assert {r.window for r in sinks.read_features(spark, str(tmp_path / "f"), ["30d"], ["code/count"]).collect()} == {"30d"}


@pytest.mark.parametrize("by_label", [False, True])
def test_stages(spark, stored, tmp_path, by_label):
    options = [f"input_dir={stored}/data", f"output_dir={tmp_path}/out", f"label_dir={stored}/labels", "windows=[30d,full]", "min_code_count=1"]
    config = TabConfig().with_overrides(options)
    if not by_label:
        config = TabConfig().with_overrides([o for o in options if not o.startswith("label_dir")])
    run = cli.Stages(spark, config)
    run.describe()
    names = features.selected_names(run.selected())
    assert {"PULSE/value", "HEIGHT/static/first", "EYES//BROWN/static/present", "ARRIVE//WARD/code", "LEAVE/code"} < set(names) and "LEAVE/value" not in names
    run.tabularize()
    cells = sinks.read_features(spark, run.features_path)
    rows = tables.read_observations(spark, config.input_dir)
    counts = cells.where("agg = 'code/count' and window = 'full' and code = 'BORN'")
    index = features.event_index(rows) if not by_label else tables.read_labels(spark, config.label_dir).select("subject_id", "time").distinct()
    assert counts.count() == index.count() and counts.where("value <> 1").count() == 0
    assert cells.where("agg = 'static/first' and code = 'HEIGHT'").count() == index.count()
    assert {r.split for r in cells.select("split").distinct().collect()} == {"train", "tuning", "held_out"}
    run.tabularize()  # complete: skipped
    if by_label:
        run.cache_task()
        assert spark.read.parquet(run.labels_path).where("event_id < 0").count() == 0
        assert 0.0 <= run.model() <= 1.0 and 0.0 <= run.model("knn", k=3) <= 1.0
        assert run.sweep(trials=3, keep=1) == next(p.name for p in (tmp_path / "out" / "sweep").iterdir() if p.is_dir() and len(p.name) == 16)
        assert spark.read.parquet(str(tmp_path / "out" / "sweep" / "sweep_results_summary.parquet")).count() == 3
        place = next((tmp_path / "out" / "models").iterdir())
        for split in ("tuning", "held_out"):
            assert spark.read.parquet(str(place / f"{split}_predictions")).schema == PREDICTIONS


@pytest.mark.parametrize("by_label", [False, True])
def test_labels_between_events(spark, stored, tmp_path, by_label):
    """Every label gets the cells of its latest event, whichever rows were tabularized."""
    rows = tables.read_observations(spark, str(stored / "data")).where("time is not null").toPandas()
    times = rows[["subject_id", "time"]].drop_duplicates().sort_values(["subject_id", "time"])
    last = times.groupby("subject_id")["time"].transform("max")
    # Two labels after each event, both before the next one, and one before all history.
    parts = [times.assign(event=times["time"], prediction_time=times["time"] + dt.timedelta(minutes=m)) for m in (7, 31)]
    parts.append(times[times["time"] == last].assign(event=pd.NaT, prediction_time=dt.datetime(1950, 1, 1)))
    labels = pd.concat(parts)
    assert labels.merge(times, left_on=["subject_id", "prediction_time"], right_on=["subject_id", "time"]).empty
    labels = labels.assign(boolean_value=[i % 3 == 0 for i in range(len(labels))], prediction_time=labels["prediction_time"].astype("datetime64[us]"))
    (tmp_path / "labels").mkdir()
    labels[["subject_id", "prediction_time", "boolean_value"]].to_parquet(tmp_path / "labels" / "0.parquet", index=False)
    options = [f"input_dir={stored}/data", f"output_dir={tmp_path}/out", "windows=[7d,full]", "aggs=[code/count,static/first]", "min_code_count=1"]
    run = cli.Stages(spark, TabConfig().with_overrides([*options, f"label_dir={tmp_path}/labels"]))
    run.describe()
    (run if by_label else cli.Stages(spark, TabConfig().with_overrides(options))).tabularize()
    run.cache_task()
    got = {(r.subject_id, r.time, r.window, r.agg, r.code): r.value for r in sinks.read_features(spark, run.cache_path).collect()}
    want = {}
    heights = {r.subject_id: r.numeric_value for r in tables.read_observations(spark, str(stored / "data")).where("code = 'HEIGHT'").collect()}
    for s, event, at in labels.dropna(subset=["event"])[["subject_id", "event", "prediction_time"]].itertuples(index=False):
        own = rows[(rows["subject_id"] == s) & (rows["time"] <= event)]
        for window, since in (("7d", event - dt.timedelta(days=7)), ("full", dt.datetime.min)):
            for code, n in own[own["time"] > since].groupby("code").size().items():
                want[s, at.to_pydatetime(), window, "code/count", code] = float(n)
        want[s, at.to_pydatetime(), "none", "static/first", "HEIGHT"] = heights[s]
    assert got == want
    vectors = run.matrix(["7d", "full"], ["code/count", "static/first"]).select("time", "features").collect()
    assert len(vectors) == len(labels) and all((r.features.numNonzeros() == 0) == (r.time.year == 1950) for r in vectors)


def test_prepared_matrix(spark, stored, tmp_path):
    """Selection, imputing and scaling are fitted on train, the latter two in this order."""
    options = [f"input_dir={stored}/data", f"output_dir={tmp_path}/out", f"label_dir={stored}/labels", "windows=[7d,full]", "aggs=[code/count,value/max]", "min_code_count=1"]
    run = cli.Stages(spark, TabConfig().with_overrides(options))
    run.describe(), run.tabularize(), run.cache_task()

    def vectors(*more):
        rows = cli.Stages(spark, TabConfig().with_overrides([*options, *more])).matrix(["7d", "full"], ["code/count", "value/max"])
        return None if rows is None else {(r.subject_id, r.time): (r.split, r.features.toArray()) for r in rows.collect()}

    plain, chosen = vectors(), vectors("max_by_correlation=1")
    assert len(next(iter(chosen.values()))[1]) < len(next(iter(plain.values()))[1]) and vectors("min_correlation=1.0") is None
    x = pd.DataFrame({k: v for k, (_, v) in plain.items()}).T
    is_train = [plain[k][0] == "train" for k in plain]
    filled = x.where(x != 0)
    filled = filled.fillna(filled[is_train].mean()).fillna(0.0)
    spread = filled[is_train].std(ddof=0).where(lambda d: d > 1e-9, 1.0)
    got = vectors("imputer=mean", "scaler=standard")
    assert all(v == pytest.approx((filled.loc[k] / spread).to_numpy(), rel=1e-6) for k, (_, v) in got.items())
    assert max(abs(v).max() for s, v in vectors("scaler=max_abs").values() if s == "train") == pytest.approx(1.0)
    assert run.sweep(trials=5, keep=1)
    for split in ("tuning", "held_out"):
        assert spark.read.parquet(str(tmp_path / "out" / "sweep" / "best_trial" / f"{split}_predictions")).schema == PREDICTIONS
    with pytest.raises(ValueError):
        TabConfig().with_overrides(["scaler=none"])


def test_no_features_left(spark, stored, tmp_path):
    config = TabConfig().with_overrides([f"input_dir={stored}/data", f"output_dir={tmp_path}/out", f"label_dir={stored}/labels", "min_code_count=100000000"])
    run = cli.Stages(spark, config)
    run.describe()
    assert run.model() == 0.0
    with pytest.raises(ValueError):
        run.tabularize()


def test_command_line(capsys):
    cli.main(["subsets", "a", "b"])
    assert capsys.readouterr().out.strip() == "[a],[a,b],[b]"
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
    with pytest.raises(ValueError):
        cli.Stages(None, TabConfig())


def test_streamed_frequencies_are_those_of_the_table(spark, tmp_path):
    rows = [(s, None if i % 3 else T, c, None if i % 2 else 1.0) for i, (s, c) in enumerate([(1, "A"), (2, "B"), (None, "A"), (1, "A"), (3, "C")] * 4)]
    for i in range(2):
        spark.createDataFrame(rows[i::2], OBS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_frequencies(stream).writeStream.format("memory").queryName("streamed").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert describe.as_dict(spark.table("streamed")) == describe.as_dict(describe.code_frequencies(spark.createDataFrame(rows, OBS)))
    with pytest.raises(ValueError):
        stream_frequencies(spark.createDataFrame(rows, OBS))


def test_coordinates(spark):
    o = spark.createDataFrame([(1, T, "A", 2.0), (1, T, "A", 3.0), (1, T, "B", None), (2, T, "B", 0.0)], OBS)
    chosen = describe.code_frequencies(o)
    index = features.event_index(o)
    cells = encode.event_cells(o, index, chosen, "value/sum")
    assert sorted((r.row, r.col, r.value) for r in cells.collect()) == [(0, 1, 2.0), (0, 1, 3.0), (1, 3, 0.0)]
    codes = encode.event_cells(o, index, chosen, "code/count")
    assert sorted((r.row, r.col) for r in codes.collect()) == [(0, 0), (0, 0), (0, 2), (1, 2)]
    back = encode.from_coordinates(encode.to_coordinates(cells))
    assert sorted(r.value for r in back.collect()) == [2.0, 3.0]
    dense = {r.row: r["values"] for r in encode.dense_rows(cells, spark.range(3).withColumnRenamed("id", "row"), 4).collect()}
    assert dense == {0: [0.0, 5.0, 0.0, 0.0], 1: [0.0] * 4, 2: [0.0] * 4}
    with pytest.raises(ValueError):
        encode.from_coordinates(cells)
    with pytest.raises(ValueError):
        encode.event_cells(o, index, chosen, "static/first")
