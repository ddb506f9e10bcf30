"""Queries of the general data-preparation operators, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.values import live_rows
from tallyloom.operators import entity, skew, trailing
from tallyloom.sources.tables import table
from tallyloom.workspace import staged


def doses(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "measurements").where(F.upper("code").contains("DOSE//"))
    return live_rows(rows).where(F.col("code").startswith("DOSE//") & F.col("time").isNotNull() & F.col("numeric_value").isNotNull())


def p1_rolling_totals(spark: SparkSession, folder: str) -> DataFrame:
    return trailing.trailing_totals(doses(spark, folder)).select(
        "subject_id", "code", F.date_format("day", "yyyy-MM-dd").alias("obs_day"), "n_7", "n_30", F.col("total_7").cast("double").alias("total_7"),
        F.col("total_30").cast("double").alias("total_30"), F.round("avg_7", 6).alias("avg_7"), F.round("avg_30", 6).alias("avg_30"),
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = trailing.bursts(trailing.trailing_totals(doses(spark, folder)))
    return found.select("subject_id", "code", F.date_format("day", "yyyy-MM-dd").alias("obs_day"))


def p1_late_corrections(spark: SparkSession, folder: str) -> DataFrame:
    """The totals as they come out when rows loaded after 2015 are put in as corrections of the earlier store."""
    rows = table(spark, folder, "measurements").where(F.upper("code").contains("DOSE//"))
    keys, late = ["subject_id", "code"], F.col("loaded_at") >= F.lit("2015-01-01").cast("timestamp_ntz")

    def leaves(part: DataFrame) -> DataFrame:
        live = live_rows(part).where(F.col("code").startswith("DOSE//") & F.col("time").isNotNull() & F.col("numeric_value").isNotNull())
        return trailing.daily_leaves(live, keys, "time", "numeric_value")

    # A re-sent row is no correction: what the later rows add is the difference of the leaves.
    before, after = leaves(rows.where(~F.coalesce(late, F.lit(False)))), leaves(rows)
    signed = after.unionByName(before.withColumn("total", -F.col("total")).withColumn("n", -F.col("n")))
    changes = signed.groupBy(*keys, "day").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("total <> 0 or n <> 0")
    stored = staged(trailing.build_trees(before, keys), "trees")
    trees = trailing.correct_trees(stored, changes, keys)
    return trailing.query_trees(trees, keys).select(
        "subject_id", "code", F.date_format("day", "yyyy-MM-dd").alias("obs_day"), "n_7", "n_30", F.col("total_7").cast("double").alias("total_7"),
        F.col("total_30").cast("double").alias("total_30"),
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return skew.heavy_keys(skew.key_quantiles(table(spark, folder, "measurements"))).select("subject_id")


def p2_key_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    return skew.key_quantiles(table(spark, folder, "measurements"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    vectors, dictionary = entity.feature_table(table(spark, folder, "measurements"))
    return entity.top_codes(vectors, dictionary)


def p3_feature_rows(spark: SparkSession, folder: str) -> DataFrame:
    vectors, dictionary = entity.feature_table(table(spark, folder, "measurements"))
    rows = entity.long_features(vectors, dictionary)
    return rows.select("subject_id", "code", "n", F.col("total").cast("double").alias("total"), "latest")


def p3_merged_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The feature rows, from vectors of two parts of the events that are then merged."""
    rows = table(spark, folder, "measurements")
    dictionary = entity.code_index(rows)
    events = entity.encode_events(rows, dictionary)
    half = F.pmod(F.xxhash64("time", "numeric_value"), F.lit(2))
    merged = entity.merge_vectors(*[entity.entity_vectors(events.where(half == i)) for i in (0, 1)])
    found = entity.long_features(merged, dictionary)
    return found.select("subject_id", "code", "n", F.col("total").cast("double").alias("total"), "latest")


def p3_table_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of the feature table, read back as rows."""
    vectors, dictionary = entity.feature_table(table(spark, folder, "measurements"))
    wide = entity.expand_columns(vectors, dictionary)
    codes = sorted({c.rpartition("/")[0] for c in wide.columns if c != "subject_id"})
    cells = [F.struct(F.lit(c).alias("code"), *[F.col(f"`{c}/{m}`").alias(to) for m, to in (("count", "n"), ("total", "total"), ("recency", "latest"))]) for c in codes]
    return wide.select("subject_id", F.explode(F.array(*cells)).alias("c")).select("subject_id", "c.*").where("n > 0")


def p3_feature_table(spark: SparkSession, folder: str) -> DataFrame:
    vectors, dictionary = entity.feature_table(table(spark, folder, "measurements"))
    return entity.expand_columns(vectors, dictionary)


_LIVE = r"""live AS (
  SELECT DISTINCT subject_id, upper(trim(code, E' \t\r\n')) AS code, time,
         CASE WHEN isfinite(numeric_value) THEN numeric_value END AS v
  FROM measurements WHERE subject_id IS NOT NULL AND code IS NOT NULL)"""

_ROLLING = rf"""WITH {_LIVE},
d AS (SELECT subject_id, code, CAST(time AS DATE) AS day, sum(CAST(v AS DECIMAL(18,1))) AS s, count(*) AS n FROM live
      WHERE time IS NOT NULL AND v IS NOT NULL AND code LIKE 'DOSE//%' GROUP BY 1, 2, 3),
spans AS (SELECT subject_id, code, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1, 2),
days AS (SELECT subject_id, code, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM spans),
r AS (SELECT a.subject_id, a.code, a.day, a.lo,
        coalesce(sum(d.s) FILTER (d.day > a.day - 7), 0) AS t7, coalesce(sum(d.s), 0) AS t30,
        coalesce(sum(d.n) FILTER (d.day > a.day - 7), 0) AS c7, coalesce(sum(d.n), 0) AS c30
      FROM days a LEFT JOIN d ON d.subject_id = a.subject_id AND d.code = a.code AND d.day <= a.day AND d.day > a.day - 30
      GROUP BY 1, 2, 3, 4)
"""
_TOTALS = "CAST(c7 AS BIGINT) AS n_7, CAST(c30 AS BIGINT) AS n_30, CAST(t7 AS DOUBLE) AS total_7, CAST(t30 AS DOUBLE) AS total_30"

SQL = {
    "p1_rolling_totals": _ROLLING + f"SELECT subject_id, code, strftime(day, '%Y-%m-%d') AS obs_day, {_TOTALS}, round(CAST(t7 AS DOUBLE) / 7, 6) AS avg_7, round(CAST(t30 AS DOUBLE) / 30, 6) AS avg_30 FROM r",
    "p1_found": _ROLLING + "SELECT subject_id, code, strftime(day, '%Y-%m-%d') AS obs_day FROM r WHERE day >= lo + 29 AND t7 > 0 AND 12 * t7 > 7 * t30",
    "p1_late_corrections": _ROLLING + f"SELECT subject_id, code, strftime(day, '%Y-%m-%d') AS obs_day, {_TOTALS} FROM r",
    "p2_found": "SELECT subject_id FROM measurements WHERE subject_id IS NOT NULL GROUP BY 1 HAVING count(*) * 50 >= (SELECT count(*) FROM measurements)",
    "p2_key_quantiles": """WITH m AS (SELECT subject_id, CASE WHEN isfinite(numeric_value) THEN numeric_value END AS v FROM measurements),
s AS (SELECT subject_id, count(*) AS n_rows, count(v) AS n_values FROM m GROUP BY 1),
r AS (SELECT subject_id, v, row_number() OVER (PARTITION BY subject_id ORDER BY v) AS i FROM m WHERE v IS NOT NULL),
q AS (SELECT s.subject_id AS k, s.n_rows, s.n_values, r.v, r.i, greatest(1, ceil(0.25 * n_values)) AS a, greatest(1, ceil(0.5 * n_values)) AS b, greatest(1, ceil(0.75 * n_values)) AS c
      FROM s LEFT JOIN r ON r.subject_id IS NOT DISTINCT FROM s.subject_id)
SELECT k AS subject_id, n_rows, n_values, max(v) FILTER (i = a) AS q25, max(v) FILTER (i = b) AS q50, max(v) FILTER (i = c) AS q75 FROM q GROUP BY 1, 2, 3""",
    "p3_found": f"""WITH {_LIVE},
f AS (SELECT subject_id, code, count(*) AS n, max(time) AS latest, sum(CAST(v AS DECIMAL(18,1))) AS total FROM live WHERE time IS NOT NULL GROUP BY 1, 2),
m AS (SELECT *, max(n) OVER w AS mn, max(latest) OVER w AS ml, max(total) OVER w AS mt FROM f WINDOW w AS (PARTITION BY subject_id))
SELECT subject_id, 'count' AS measure, code FROM m WHERE n = mn
UNION ALL SELECT subject_id, 'recency', code FROM m WHERE latest = ml
UNION ALL SELECT subject_id, 'total', code FROM m WHERE total = mt""",
    **dict.fromkeys(("p3_feature_rows", "p3_merged_rows", "p3_table_rows"), f"""WITH {_LIVE}
SELECT subject_id, code, count(*) AS n, CAST(sum(CAST(v AS DECIMAL(18,1))) AS DOUBLE) AS total, max(time) AS latest
FROM live WHERE time IS NOT NULL GROUP BY 1, 2"""),
}

QUERIES = {
    "p1_found": p1_found,
    "p1_rolling_totals": p1_rolling_totals,
    "p1_late_corrections": p1_late_corrections,
    "p2_found": p2_found,
    "p2_key_quantiles": p2_key_quantiles,
    "p3_found": p3_found,
    "p3_feature_rows": p3_feature_rows,
    "p3_merged_rows": p3_merged_rows,
    "p3_table_rows": p3_table_rows,
    "p3_feature_table": p3_feature_table,
}
