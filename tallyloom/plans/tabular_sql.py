"""SQL for the queries of ``tabular``, written on its own from what each query is to give."""

from __future__ import annotations

_EVENTS = """e AS (SELECT user_id AS subject_id, ts AS time, event_type AS code,
       CASE WHEN event_type NOT IN ('view', 'click') THEN CAST(value AS DECIMAL(18,2)) END AS v FROM events)"""
_SHIPPED = """e AS (SELECT o_custkey AS subject_id, l_shipdate AS time, 'SHIP//' || l_returnflag || '//' || l_linestatus AS code,
       CAST(l_discount AS DECIMAL(18,2)) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_MEASURED = r"""e AS (SELECT subject_id, time, upper(trim(code, E' \t\r\n')) AS code,
       CAST(CASE WHEN isfinite(numeric_value) THEN numeric_value END AS DECIMAL(18,1)) AS v FROM measurements)"""
_INDEX = "i AS (SELECT DISTINCT subject_id, time FROM e WHERE subject_id IS NOT NULL AND time IS NOT NULL)"
_LABELS = """d AS (SELECT DISTINCT user_id AS subject_id, date_trunc('day', ts) AS time FROM events),
l AS (SELECT d.subject_id, CAST(d.time AS TIMESTAMP) AS time, CAST(EXISTS (SELECT 1 FROM events p WHERE p.user_id = d.subject_id AND p.event_type = 'purchase'
        AND p.ts > d.time AND p.ts <= d.time + INTERVAL 7 DAY) AS INTEGER) AS label FROM d)"""
_INTERVALS = {"2h": "2 HOUR", "12h": "12 HOUR", "1d": "1 DAY", "7d": "7 DAY", "30d": "30 DAY", "365d": "365 DAY"}
_AGGS = {
    "code/count": "CAST(count(*) AS BIGINT) AS code_count",
    "value/count": "CAST(count(e.v) AS BIGINT) AS value_count",
    "value/sum": "CAST(sum(e.v) AS DOUBLE) AS value_sum",
    "value/sum_sqd": "CAST(sum(e.v * e.v) AS DOUBLE) AS value_sum_sqd",
    "value/min": "CAST(min(e.v) AS DOUBLE) AS value_min",
    "value/max": "CAST(max(e.v) AS DOUBLE) AS value_max",
}


def _within(window: str, at: str = "i.time") -> str:
    return f"e.time <= {at}" + ("" if window == "full" else f" AND e.time > {at} - INTERVAL {_INTERVALS[window]}")


def _rolled(window: str, aggs: list[str], rows: str = "i", at: str = "i.time") -> str:
    return f"""SELECT i.subject_id, i.time, e.code, '{window}' AS "window", {", ".join(_AGGS[a] for a in aggs)}
FROM {rows} i JOIN e ON e.subject_id = i.subject_id AND {_within(window, at)} WHERE e.code IS NOT NULL GROUP BY i.subject_id, i.time, e.code"""


def _each(windows, aggs=tuple(_AGGS), base=_EVENTS) -> str:
    return f"WITH {base}, {_INDEX}\n" + "\nUNION ALL\n".join(_rolled(w, list(aggs)) for w in windows)


def _single(agg: str, window: str) -> str:
    column = _AGGS[agg].rpartition(" ")[2]
    return f"WITH {_EVENTS}, {_INDEX}, r AS ({_rolled(window, [agg])}) SELECT * FROM r WHERE {column} IS NOT NULL"


def _melted(query: str) -> str:
    return f"""SELECT subject_id, time, "window", 'code/count' AS agg, code, CAST(code_count AS DOUBLE) AS value FROM ({query})
UNION ALL SELECT subject_id, time, "window", 'value/sum', code, value_sum FROM ({query}) WHERE value_sum IS NOT NULL"""


_F = """f AS (SELECT code || '/' || kind AS code, n AS count FROM (
  SELECT code, 'static/present' AS kind, count(*) AS n FROM e WHERE subject_id IS NOT NULL AND code IS NOT NULL AND time IS NULL GROUP BY 1
  UNION ALL SELECT code, 'static/first', count(v) FROM e WHERE subject_id IS NOT NULL AND code IS NOT NULL AND time IS NULL GROUP BY 1
  UNION ALL SELECT code, 'code', count(*) FROM e WHERE subject_id IS NOT NULL AND code IS NOT NULL AND time IS NOT NULL GROUP BY 1
  UNION ALL SELECT code, 'value', count(v) FROM e WHERE subject_id IS NOT NULL AND code IS NOT NULL AND time IS NOT NULL GROUP BY 1) WHERE n > 0)"""
_FREQ = f"WITH {_MEASURED}, {_F}\n"
_CELLS_OF = f"""WITH {_EVENTS}, {_INDEX}, {_F},
n AS (SELECT *, row_number() OVER (ORDER BY subject_id, time) - 1 AS "row" FROM i),
k AS (SELECT code, row_number() OVER (ORDER BY code) - 1 AS col FROM f)
SELECT n."row", k.col, CAST({{value}} AS DOUBLE) AS value FROM e JOIN n USING (subject_id, time) JOIN k ON k.code = e.code || '/{{kind}}' WHERE {{where}}"""
_CELLS = f"""{_EVENTS}, {_LABELS},
c7 AS ({_rolled("7d", ["code/count", "value/sum"], "l")}), cf AS ({_rolled("full", ["code/count", "value/sum"], "l")}),
c AS (SELECT subject_id, time, "window", 'code/count' AS agg, code, CAST(code_count AS DOUBLE) AS value FROM c7
  UNION ALL SELECT subject_id, time, "window", 'value/sum', code, value_sum FROM c7 WHERE value_sum IS NOT NULL
  UNION ALL SELECT subject_id, time, "window", 'code/count', code, CAST(code_count AS DOUBLE) FROM cf
  UNION ALL SELECT subject_id, time, "window", 'value/sum', code, value_sum FROM cf WHERE value_sum IS NOT NULL)"""
_CORR = f"""{_CELLS},
t AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(CAST(label AS DOUBLE)) AS sy, sum(CAST(label AS DOUBLE)) AS syy FROM l),
s AS (SELECT "window", agg, c.code, sum(value) AS sx, sum(value * value) AS sxx, sum(value * label) AS sxy FROM c JOIN l USING (subject_id, time) GROUP BY 1, 2, 3),
r AS (SELECT "window", agg, code, (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) AS r FROM s, t)"""
_ALIGNED = f"""{_EVENTS}, {_INDEX}, {_LABELS},
n AS (SELECT *, row_number() OVER (ORDER BY subject_id, time) - 1 AS event_id FROM i),
a AS (SELECT l.subject_id, l.time, l.label, n.time AS event_time, coalesce(n.event_id, -1) AS event_id
      FROM l ASOF LEFT JOIN n ON n.subject_id = l.subject_id AND n.time <= l.time)"""
_WIDE_STATIC = "SELECT c_custkey AS subject_id, c_acctbal AS \"ACCTBAL/static/first\", " + ", ".join(
    f"c_mktsegment = '{s}' AS \"SEGMENT//{s}/static/present\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
)
_IMPUTE = {
    "mean": "avg(value)",
    "median": "median(value)",
    "mode": "min(value) FILTER (k = m)",
}


def _label_rolled(window: str) -> str:
    return f"""WITH {_ALIGNED}, b AS (SELECT subject_id, time, event_time FROM a WHERE event_time IS NOT NULL)
SELECT i.subject_id, i.time, e.code, '{window}' AS "window", {", ".join(_AGGS.values())}
FROM b i JOIN e ON e.subject_id = i.subject_id AND {_within(window, "i.event_time")} GROUP BY 1, 2, 3"""


def _imputed(strategy: str) -> str:
    return f"""WITH {_CELLS},
k AS (SELECT agg, code, value, count(*) AS k FROM c WHERE "window" = '7d' GROUP BY 1, 2, 3),
m AS (SELECT *, max(k) OVER (PARTITION BY agg, code) AS m FROM k),
x AS (SELECT c.agg, c.code, {_IMPUTE[strategy].replace("value", "c.value").replace("k =", "m.k =").replace("= m)", "= m.m)")} AS fill FROM c JOIN m ON m.agg = c.agg AND m.code = c.code AND m.value = c.value WHERE c."window" = '7d' GROUP BY 1, 2)
SELECT l.subject_id, l.time, '7d' AS "window", x.agg, x.code, round(coalesce(c.value, x.fill), 6) AS value
FROM l, x LEFT JOIN c ON c.subject_id = l.subject_id AND c.time = l.time AND c."window" = '7d' AND c.agg = x.agg AND c.code = x.code"""


SQL = {
    "describe_code_frequencies": _FREQ + "SELECT * FROM f",
    "select_codes_allowed": _FREQ + "SELECT * FROM f WHERE code IN ('VITAL//PULSE/code', 'VITAL//PULSE/value', 'BORN/code', 'NOWHERE/code')",
    "select_codes_min_count": _FREQ + "SELECT * FROM f WHERE count >= 100",
    "select_codes_min_frequency": _FREQ + "SELECT * FROM f WHERE count / (SELECT sum(count) FROM f) >= 0.004",
    "select_codes_top_k": _FREQ + "SELECT * FROM f ORDER BY count DESC, code LIMIT 25",
    "select_codes_combined": _FREQ + "SELECT * FROM f WHERE count / (SELECT sum(count) FROM f) >= 0.001 AND count >= 50 ORDER BY count DESC, code LIMIT 40",
    "restricted_metadata": _FREQ + "SELECT * FROM code_metadata WHERE code IN (SELECT code FROM f WHERE count >= 100)",
    "feature_positions": _FREQ + "SELECT code, row_number() OVER (ORDER BY code) - 1 AS position FROM f WHERE count >= 20",
    "feature_indices_by_aggregation": _FREQ + "SELECT * FROM (SELECT code, row_number() OVER (ORDER BY code) - 1 AS position FROM f WHERE count >= 20) WHERE code LIKE '%/value'",
    "encoded_code_cells": _CELLS_OF.format(kind="code", value="1.0", where="true"),
    "encoded_value_cells": _CELLS_OF.format(kind="value", value="CAST(e.v AS DOUBLE)", where="e.v IS NOT NULL"),
    "filter_rare_observations": _FREQ
    + """, g AS (SELECT code FROM f WHERE count >= 60)
SELECT subject_id, time, code, CASE WHEN code || CASE WHEN time IS NULL THEN '/static/first' ELSE '/value' END IN (SELECT code FROM g) THEN CAST(v AS DOUBLE) END AS numeric_value
FROM e WHERE code || CASE WHEN time IS NULL THEN '/static/present' ELSE '/code' END IN (SELECT code FROM g)""",
    "events_projection": _FREQ
    + """, g AS (SELECT DISTINCT regexp_replace(code, '/?[^/]*$', '') AS code FROM f WHERE count >= 60)
SELECT subject_id, time, code, CAST(v AS DOUBLE) AS numeric_value FROM e WHERE time IS NOT NULL AND code IN (SELECT code FROM g)""",
    "unique_event_index": f"WITH {_MEASURED}, {_INDEX} SELECT subject_id, time, row_number() OVER (ORDER BY subject_id, time) - 1 AS event_id FROM i",
    "static_first": f"WITH {_MEASURED} SELECT subject_id, code, round(avg(CAST(v AS DOUBLE)), 6) AS value FROM e WHERE time IS NULL AND subject_id IS NOT NULL AND code IS NOT NULL AND v IS NOT NULL GROUP BY 1, 2",
    "static_present": f"WITH {_MEASURED} SELECT DISTINCT subject_id, code, true AS present FROM e WHERE time IS NULL AND subject_id IS NOT NULL AND code IS NOT NULL",
    "static_wide": _WIDE_STATIC + " FROM customer",
    "static_replicated": f"WITH {_EVENTS}, {_INDEX}, w AS ({_WIDE_STATIC} FROM customer) SELECT * FROM i LEFT JOIN w USING (subject_id)",
    "same_time_collapse": f"WITH {_SHIPPED} SELECT subject_id, time, code, count(*) AS n, count(v) AS nv, CAST(sum(v) AS DOUBLE) AS s, CAST(sum(v * v) AS DOUBLE) AS ss, CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM e GROUP BY 1, 2, 3",
    **{f"rolling_{a.replace('/', '_')}_{w}": _single(a, w) for a in _AGGS for w in (*_INTERVALS, "full")},
    "rolling_all": _each([*_INTERVALS, "full"]),
    "rolling_all_by_spine": _each([*_INTERVALS, "full"]),
    "rolling_shipments": _each(["30d", "full"], base=_SHIPPED),
    "rolling_measurements": _each(["1d"], base=_MEASURED),
    **{
        f"rolling_window_bounds_{w}": f"""WITH {_EVENTS}, {_INDEX}, n AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY time) - 1 AS k FROM i)
SELECT i.subject_id, i.time, min(e.k) AS min_index, max(e.k) + 1 AS max_index FROM n i JOIN n e ON e.subject_id = i.subject_id AND {_within(w)} GROUP BY 1, 2"""
        for w in ("7d", "full")
    },
    "long_feature_table": f"WITH {_EVENTS}, {_INDEX}, r AS ({_rolled('1d', ['code/count', 'value/sum'])} UNION ALL {_rolled('7d', ['code/count', 'value/sum'])})\n" + _melted("SELECT * FROM r"),
    "label_asof_event": f"WITH {_ALIGNED} SELECT subject_id, time, label, event_time FROM a",
    "label_window_features_7d": _label_rolled("7d"),
    "label_window_features_full": _label_rolled("full"),
    "label_window_features_own_time_7d": f"WITH {_EVENTS}, {_LABELS} " + _rolled("7d", list(_AGGS), "l"),
    "cache_task_labels": f"WITH {_ALIGNED} SELECT * FROM a",
    "cache_task_rows": f"WITH {_ALIGNED}, r AS ({_rolled('1d', ['code/count', 'value/sum'])} UNION ALL {_rolled('7d', ['code/count', 'value/sum'])}), m AS ({_melted('SELECT * FROM r')})"
    + """ SELECT a.subject_id, a.time, m."window", m.agg, m.code, m.value FROM a JOIN m ON m.subject_id = a.subject_id AND m.time = a.event_time""",
    "label_dedup_first": """SELECT subject_id, prediction_time AS time, label_id, boolean_value AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id, prediction_time ORDER BY label_id) AS i FROM task_labels WHERE subject_id IS NOT NULL AND prediction_time IS NOT NULL) WHERE i = 1""",
    "labels_semi_subjects": "SELECT label_id, subject_id, prediction_time AS time, boolean_value AS label FROM task_labels WHERE subject_id IN (SELECT subject_id FROM measurements WHERE time IS NOT NULL AND subject_id IS NOT NULL)",
    "labels_per_class": "SELECT CAST(boolean_value AS INTEGER) AS label, count(*) AS n FROM task_labels GROUP BY 1",
    "feature_columns": f"""WITH {_EVENTS}, {_F},
b AS (SELECT * FROM (VALUES ('1d', 'code/count'), ('full', 'code/count'), ('1d', 'value/sum'), ('full', 'value/sum'), ('1d', 'value/max'), ('full', 'value/max')) AS t(w, agg)),
n AS (SELECT w || '/' || agg AS path, f.code AS feature, regexp_replace(f.code, '/(code|value)$', '') || '/' || agg || '/' || w AS name
      FROM b JOIN f ON f.code LIKE '%/' || split_part(agg, '/', 1))
SELECT row_number() OVER (ORDER BY path, feature) - 1 AS idx, name FROM n""",
    "feature_label_correlation": f'WITH {_CORR} SELECT "window", agg, code, round(r, 6) AS r FROM r',
    "select_min_correlation": f"WITH {_CORR} SELECT code FROM r GROUP BY 1 HAVING max(abs(r)) > 0.05",
    "select_max_by_correlation": f"WITH {_CORR} SELECT code FROM r GROUP BY 1 ORDER BY max(abs(r)) DESC, code LIMIT 2",
    "scale_standard": f"""WITH {_CELLS.replace("c AS (", "c AS MATERIALIZED (").replace("l AS (", "l AS MATERIALIZED (")},
q AS (SELECT "window", agg, code, sum(value * value) AS q, sum(value) AS m FROM c GROUP BY 1, 2, 3),
n AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n FROM l),
s AS (SELECT "window", agg, code, sqrt(greatest(q / (SELECT n FROM n) - (m / (SELECT n FROM n)) * (m / (SELECT n FROM n)), 0)) AS d FROM q)
SELECT subject_id, time, "window", agg, code, round(value / CASE WHEN d > 0 THEN d ELSE 1 END, 6) AS value FROM c JOIN s USING ("window", agg, code)""",
    "scale_max_abs": f"""WITH {_CELLS}, s AS (SELECT "window", agg, code, max(abs(value)) AS d FROM c GROUP BY 1, 2, 3)
SELECT subject_id, time, "window", agg, code, round(value / CASE WHEN d > 0 THEN d ELSE 1 END, 6) AS value FROM c JOIN s USING ("window", agg, code)""",
    "select_count_and_correlation": f"WITH {_CORR}, {_F} SELECT code, count FROM f WHERE count >= 500 AND regexp_replace(code, '/(code|value)$', '') IN (SELECT code FROM r GROUP BY 1 HAVING max(abs(r)) > 0.05)",
    "preprocessed_cells": f"""WITH {_CELLS},
x AS (SELECT agg, code, avg(value) AS fill FROM c WHERE "window" = '7d' AND subject_id % 10 < 7 GROUP BY 1, 2),
dense AS MATERIALIZED (SELECT l.subject_id, l.time, x.agg, x.code, coalesce(c.value, x.fill) AS value
  FROM l CROSS JOIN x LEFT JOIN c ON c.subject_id = l.subject_id AND c.time = l.time AND c."window" = '7d' AND c.agg = x.agg AND c.code = x.code),
spread AS (SELECT agg, code, stddev_pop(value) AS s FROM dense WHERE subject_id % 10 < 7 GROUP BY 1, 2)
SELECT subject_id, time, '7d' AS "window", agg, code, round(value / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS value FROM dense JOIN spread USING (agg, code)""",
    "impute_mean": _imputed("mean"),
    "impute_median": _imputed("median"),
    "impute_mode": _imputed("mode"),
    "auc_exact": f"""WITH {_CELLS}, t AS (SELECT subject_id, time, sum(value) AS s FROM c WHERE "window" = '7d' AND agg = 'code/count' GROUP BY 1, 2),
x AS (SELECT label AS y, coalesce(s, 0) AS s FROM l LEFT JOIN t USING (subject_id, time)),
g AS (SELECT s, sum(y) AS p, count(*) - sum(y) AS n FROM x GROUP BY 1),
k AS (SELECT *, sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS below FROM g)
SELECT round(coalesce(CAST(sum(p * (below + 0.5 * n)) AS DOUBLE) / nullif(CAST(sum(p) * sum(n) AS DOUBLE), 0), 0), 9) AS auc FROM k""",
    "sparse_vector_cells": f"""WITH {_CELLS}, {_F},
b AS (SELECT * FROM (VALUES ('7d', 'code/count'), ('full', 'code/count'), ('7d', 'value/sum'), ('full', 'value/sum')) AS t(w, agg)),
k AS (SELECT w, agg, regexp_replace(f.code, '/(code|value)$', '') AS code, row_number() OVER (ORDER BY w || '/' || agg, f.code) - 1 AS idx FROM b JOIN f ON f.code LIKE '%/' || split_part(agg, '/', 1))
SELECT subject_id, time, CAST(idx AS INTEGER) AS idx, round(value, 6) AS value FROM c JOIN k ON k.w = c."window" AND k.agg = c.agg AND k.code = c.code WHERE value <> 0""",
    "rank_trials_top_k": "SELECT s_name AS trial_name, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS tuning_auc, s_acctbal AS test_auc FROM supplier ORDER BY tuning_auc DESC NULLS LAST, trial_name LIMIT 10",
    "non_empty_subsets": """WITH r AS (SELECT list(r_name ORDER BY r_name) AS x FROM region), b AS (SELECT unnest(range(1, CAST(2 ** len(x) AS BIGINT))) AS m, x FROM r)
SELECT array_to_string(list_filter(x, lambda v, k: (m >> (k - 1)) & 1 = 1), ',') AS subset FROM b""",
    "task_labels_repeat_purchase": f"""WITH {_EVENTS}, t AS (SELECT DISTINCT subject_id, time FROM e WHERE code = 'purchase')
SELECT subject_id, time + INTERVAL 1 DAY AS prediction_time,
  EXISTS (SELECT 1 FROM e WHERE e.subject_id = t.subject_id AND e.code = 'purchase' AND e.time > t.time + INTERVAL 1 DAY AND e.time <= t.time + INTERVAL 8 DAY) AS boolean_value
FROM t WHERE (SELECT count(*) FROM e WHERE e.subject_id = t.subject_id AND e.code IN ('view', 'click') AND e.time <= t.time + INTERVAL 1 DAY) >= 2""",
    "task_labels_next_visit": f"""WITH {_EVENTS}, t AS (SELECT DISTINCT subject_id, time FROM e WHERE code = 'purchase'),
n AS (SELECT subject_id, time, (SELECT min(e.time) FROM e WHERE e.subject_id = t.subject_id AND e.code = 'view' AND e.time > t.time) AS nxt FROM t),
c AS (SELECT *, (SELECT count(*) FROM e WHERE e.subject_id = n.subject_id AND e.code = 'purchase' AND e.time > n.time AND e.time <= n.nxt) AS k FROM n WHERE nxt IS NOT NULL)
SELECT subject_id, nxt AS prediction_time, k > 0 AS boolean_value FROM c WHERE k <= 1""",
    "knn_predictions": f"""WITH {_CELLS},
w AS (SELECT l.subject_id, l.time, l.label, row_number() OVER (ORDER BY l.subject_id, l.time) - 1 AS "row", l.subject_id % 10 AS g,
  coalesce(max(value) FILTER (c.code = 'click'), 0) AS a, coalesce(max(value) FILTER (c.code = 'error'), 0) AS b, coalesce(max(value) FILTER (c.code = 'purchase'), 0) AS d,
  coalesce(max(value) FILTER (c.code = 'signup'), 0) AS s, coalesce(max(value) FILTER (c.code = 'view'), 0) AS v
  FROM l LEFT JOIN c ON c.subject_id = l.subject_id AND c.time = l.time AND c."window" = '7d' AND c.agg = 'code/count' GROUP BY 1, 2, 3),
p AS (SELECT q."row", t.label, row_number() OVER (PARTITION BY q."row" ORDER BY (q.a-t.a)*(q.a-t.a)+(q.b-t.b)*(q.b-t.b)+(q.d-t.d)*(q.d-t.d)+(q.s-t.s)*(q.s-t.s)+(q.v-t.v)*(q.v-t.v), t.label) AS k
  FROM w q JOIN w t ON q.g = 9 AND t.g < 7)
SELECT "row", round(CAST(sum(label) AS DOUBLE) / 5, 9) AS score FROM p WHERE k <= 5 GROUP BY 1""",
}
