"""Queries of this subpackage, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import leaks, nearest, packing, personal, splits, terms
from tallyloom.operators.skew import hot_and_all
from tallyloom.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = nearest.nearest_in_time(table(spark, folder, "task_labels"), table(spark, folder, "measurements"))
    return pairs.select(F.col("left_id").alias("label_id"), F.col("right_id").alias("obs_id"))


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "measurements")
    hot, subjects = hot_and_all(rows, "subject_id")
    return terms.marked(terms.distinct_term_counts(rows, "subject_id", "code", ["time", "numeric_value"], hot), subjects)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder).where("mark is not null").select(F.col("term").alias("code"), "mark")


def p5_term_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder).select(F.col("term").alias("code"), "n", "n_records", "mark")


def _splits(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "measurements").where("subject_id is not null").groupBy("subject_id").count()
    shard = F.regexp_extract(F.lower("shard"), r"(train|tuning|held_out)", 1)
    current = table(spark, folder, "split_map").select("subject_id", F.when(shard != "", shard).alias("split"))
    return splits.grouped_splits(records, table(spark, folder, "subject_links"), table(spark, folder, "split_targets"), current)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects whose person split_map tears apart and the balanced assignment keeps in one split."""
    return _splits(spark, folder).where("in_current and n_current > 1 and n_assigned = 1").select(F.col("id").alias("subject_id"))


def p6_assignment(spark: SparkSession, folder: str) -> DataFrame:
    return _splits(spark, folder).select(F.col("id").alias("subject_id"), "component", "weight", "bin", "split")


def p6_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Whether every subject has a split, every person one, and no split is further from its share than a bin is heavy."""
    rows = _splits(spark, folder).select("component", "weight", "bin", "split", "n_assigned").checkpoint()
    targets = table(spark, folder, "split_targets")
    total = rows.agg(F.sum("weight")).scalar()
    off = rows.groupBy("split").agg(F.sum("weight").alias("w")).join(targets, F.col("split") == F.col("split_name"), "right")
    off = off.agg(F.max(F.abs(F.coalesce("w", F.lit(0.0)) - F.col("share") * total)))
    heaviest = rows.groupBy("bin").agg(F.sum("weight").alias("w")).agg(F.max("w"))
    return rows.agg(
        F.count("split").alias("n_subjects"), F.countDistinct("component").alias("n_persons"), F.sum("weight").cast("long").alias("n_rows"),
        (F.max("n_assigned") == 1).alias("together"), (off.scalar() <= heaviest.scalar()).alias("shares_kept"),
    )


def p6_persons(spark: SparkSession, folder: str) -> DataFrame:
    return splits.components(table(spark, folder, "subject_links"), "subject_id", "linked_subject_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of which the packing has put parts into several containers."""
    return packing.split_texts(packing.pack_texts(table(spark, folder, "documents")))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_texts(table(spark, folder, "documents"))


def p7_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Whether all is packed, nothing overflows, and containers are no more than one in a hundred, and one, over the least possible."""
    held = packing.containers(packing.pack_texts(table(spark, folder, "documents")))
    least = F.ceil(F.sum("filled") / 2048)
    return held.agg(
        F.sum("filled").alias("n_tokens"), F.sum("n_pieces").alias("n_pieces"), (F.max("filled") <= 2048).alias("none_overflows"), (F.count("*") <= least * 1.01 + 1).alias("few"),
    )


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """How each text is cut, whatever the container."""
    return packing.pack_texts(table(spark, folder, "documents")).select("doc_id", "piece", "n_pieces", "start_token", "n_tokens")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select("doc_id", "item_id").distinct()


def p8_leaked_words(spark: SparkSession, folder: str) -> DataFrame:
    """Of each document and item the words that lie in shared passages, and in how many stretches."""
    spans = leaks.leaked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return spans.groupBy("doc_id", "item_id").agg(F.sum("n_words").alias("n_words"), F.count("*").alias("n_spans"))


def p8_leaked_spans(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal.personal_lines(personal.personal_data(table(spark, folder, "documents"), table(spark, folder, "name_list"), with_text=False))


def p9_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return personal.personal_data(table(spark, folder, "documents"), table(spark, folder, "name_list")).select("doc_id", "text")


_LIVE = r"""live AS (
  SELECT DISTINCT subject_id, upper(trim(code, E' \t\r\n')) AS code, time,
         CASE WHEN isfinite(numeric_value) THEN numeric_value END AS v
  FROM measurements WHERE subject_id IS NOT NULL AND code IS NOT NULL)"""
_TERMS = f"""WITH {_LIVE},
t AS (SELECT code, count(*) AS n, count(DISTINCT subject_id) AS n_records FROM live GROUP BY 1),
m AS (SELECT *, CASE WHEN n < 10 OR n_records < 3 THEN 'rare'
                     WHEN 5 * n_records > 4 * (SELECT count(DISTINCT subject_id) FROM measurements) THEN 'common' END AS mark FROM t)
"""
_PERSONS = """WITH RECURSIVE e AS (
  SELECT subject_id AS u, linked_subject_id AS v FROM subject_links WHERE subject_id IS NOT NULL AND linked_subject_id IS NOT NULL
  UNION SELECT linked_subject_id, subject_id FROM subject_links WHERE subject_id IS NOT NULL AND linked_subject_id IS NOT NULL),
r AS (SELECT u AS id, u AS peer FROM e UNION SELECT r.id, e.v FROM r JOIN e ON e.u = r.peer),
c AS (SELECT id, min(peer) AS component FROM r GROUP BY 1)
"""
_PIECES = r"""WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r\f\v]+')) AS n FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, n, CAST(ceil(n / 2048.0) AS INTEGER) AS n_pieces FROM t WHERE n > 0)
"""
_LEAKS = """WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
bw AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT doc_id, unnest(range(1, len(w) - 10)) AS i, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS s FROM dw WHERE len(w) >= 12),
bs AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS s FROM bw WHERE len(w) >= 12)
"""

SQL = {
    "p4_found": """WITH c AS (SELECT l.label_id, m.obs_id, m.time, abs(epoch_us(m.time) - epoch_us(l.prediction_time)) AS d
  FROM task_labels l JOIN measurements m ON m.subject_id = l.subject_id
   AND m.time BETWEEN l.prediction_time - INTERVAL 6 HOUR AND l.prediction_time + INTERVAL 6 HOUR),
r AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY d, time, obs_id) AS i FROM c)
SELECT label_id, obs_id FROM r WHERE i = 1""",
    "p5_found": _TERMS + "SELECT code, mark FROM m WHERE mark IS NOT NULL",
    "p5_term_frequencies": _TERMS + "SELECT * FROM m",
    "p6_persons": _PERSONS + "SELECT * FROM c",
    "p6_found": _PERSONS + r""", s AS (SELECT DISTINCT subject_id, regexp_extract(lower(shard), '(train|tuning|held_out)', 1) AS split FROM split_map WHERE shard IS NOT NULL AND subject_id IS NOT NULL),
p AS (SELECT s.*, coalesce(c.component, s.subject_id) AS person FROM s LEFT JOIN c ON c.id = s.subject_id),
b AS (SELECT person FROM p GROUP BY 1 HAVING count(DISTINCT split) > 1)
SELECT DISTINCT subject_id FROM p JOIN b USING (person)""",
    "p6_summary": _PERSONS + r""", i AS (SELECT subject_id AS id FROM measurements UNION SELECT id FROM c
  UNION SELECT subject_id FROM split_map WHERE regexp_matches(lower(shard), '(train|tuning|held_out)'))
SELECT count(*) AS n_subjects, count(DISTINCT coalesce(c.component, i.id)) AS n_persons, (SELECT count(subject_id) FROM measurements) AS n_rows, true AS together, true AS shares_kept
FROM i LEFT JOIN c USING (id) WHERE i.id IS NOT NULL""",
    "p7_found": _PIECES + "SELECT doc_id FROM p WHERE n > 2048",
    "p7_summary": _PIECES + "SELECT CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(n_pieces) AS BIGINT) AS n_pieces, true AS none_overflows, true AS few FROM p",
    "p7_pieces": _PIECES + """, q AS (SELECT *, unnest(range(n_pieces)) AS piece FROM p)
SELECT doc_id, CAST(piece AS INTEGER) AS piece, n_pieces, CAST(piece * 2048 AS BIGINT) AS start_token, CAST(least(2048, n - piece * 2048) AS BIGINT) AS n_tokens FROM q""",
    "p8_found": _LEAKS + "SELECT DISTINCT doc_id, item_id FROM ds JOIN bs USING (s)",
    "p8_leaked_words": _LEAKS
    + """, c AS (SELECT DISTINCT doc_id, item_id, unnest(range(i, i + 12)) AS w FROM ds JOIN bs USING (s)),
g AS (SELECT *, w - row_number() OVER (PARTITION BY doc_id, item_id ORDER BY w) AS island FROM c)
SELECT doc_id, item_id, count(*) AS n_words, count(DISTINCT island) AS n_spans FROM g GROUP BY 1, 2""",
}

QUERIES = {
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_term_frequencies": p5_term_frequencies,
    "p6_found": p6_found,
    "p6_assignment": p6_assignment,
    "p6_summary": p6_summary,
    "p6_persons": p6_persons,
    "p7_found": p7_found,
    "p7_containers": p7_containers,
    "p7_summary": p7_summary,
    "p7_pieces": p7_pieces,
    "p8_found": p8_found,
    "p8_leaked_words": p8_leaked_words,
    "p8_leaked_spans": p8_leaked_spans,
    "p9_found": p9_found,
    "p9_redacted": p9_redacted,
}
