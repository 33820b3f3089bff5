"""Queries over sinks, reports and alerts: what is written is read back, and replayed batches are part of it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from kestrel.functions import scalars
from kestrel.operators import code, interface, reports, shared, state
from kestrel.plans.catalogue import register, SEVERITY
from kestrel.plans.derived import _PATHED
from kestrel.streaming import alerts


@register(
    "WITH RECURSIVE f(ts) AS (SELECT min(ts) FROM events UNION ALL SELECT min(e.ts) FROM f JOIN events e ON e.ts > f.ts + INTERVAL 5 HOUR GROUP BY f.ts) SELECT 'scan' AS kind, ts FROM f"
)
def _throttled_scans(spark, read):
    """All events ask for one scan, which runs once in five hours at most: one key holds every row."""
    return state.cooldown(read("events").select(F.lit("scan").alias("kind"), "ts"), ["kind"], "ts", 5 * 3600)


@register("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:15'")
def _graced_events(spark, read):
    return alerts.startup_grace(read("events"), dt.datetime(2024, 1, 10)).select("event_id", "ts")


PATHS = f"concat(CASE p_partkey % 7 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/app/' WHEN 2 THEN 'mytests/' WHEN 3 THEN 'pages/' WHEN 4 THEN 'a/routes/' ELSE '' END, {_PATHED}, CASE p_partkey % 5 WHEN 0 THEN '/test_x.py' WHEN 1 THEN '/x_test.py' WHEN 2 THEN '/conftest.py' WHEN 3 THEN '/test_dir/x.py' ELSE '' END)"


@register(
    f"SELECT p_partkey AS k, regexp_matches(path, '(^|/)tests/|(^|/)conftest\\.py$|(^|/)test_[^/]*\\.py$|_test\\.py$') AS test_scope, len(list_intersect(string_split(path, '/')[:-2], ['app', 'pages', 'routes'])) > 0 AS route FROM (SELECT p_partkey, {PATHS} AS path FROM part)"
)
def _scope_predicates(spark, read):
    path = F.expr(PATHS)
    return read("part").select(F.col("p_partkey").alias("k"), code.is_test_scope(path).alias("test_scope"), scalars.is_route_path(path).alias("route"))


@register("SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, count(*) AS events, max(value) AS top FROM events WHERE ts IS NOT NULL AND user_id % 4 > 0 GROUP BY 1, 2")
def _day_upserts(spark, read):
    """Three batches of running sums by day; the second is run twice, as after a failure."""
    path = shared.folder(spark, "upserts")
    sink = alerts.upsert_sink(path, ["day", "user_id"], "day")
    sums = read("events").where("ts is not null").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id").agg(F.count("*").alias("events"), F.max("value").alias("top"))
    old = sums.withColumns({"events": F.lit(0).cast("long"), "top": F.lit(0.0)})
    for number, batch in ((0, old.where("user_id % 4 in (1, 2)")), (1, sums.where("user_id % 4 in (2, 3)")), (1, sums.where("user_id % 4 in (2, 3)")), (2, sums.where("user_id % 4 = 1"))):
        sink(batch, number)
    return spark.read.schema(sums.schema).parquet(path)


@register("SELECT p_partkey AS k, p_brand AS brand, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN p_size + 100 ELSE p_size END AS v FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2') OR p_size > 10")
def _replaced_partitions(spark, read):
    path = shared.folder(spark, "partitions")
    rows = read("part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"), F.col("p_size").alias("v"))
    reports.replace_partitions(rows, path, ["brand"])
    reports.replace_partitions(rows.where("brand in ('Brand#1', 'Brand#2') and v > 10").withColumn("v", (F.col("v") + 100).cast(rows.schema["v"].dataType)), path, ["brand"])
    return spark.read.schema(rows.schema).parquet(path)


_FOUND = f"SELECT user_id AS project, concat(CASE WHEN event_id % 3 = 0 THEN 'dead.' ELSE 'debt.' END, event_type) AS check_id, {SEVERITY} AS severity, concat('Finding ', event_id) AS title, CASE WHEN event_id % 4 > 0 THEN concat('seen at ', user_id) END AS message FROM events"


@register(
    f"""WITH f AS ({_FOUND}), r AS (SELECT *, row_number() OVER (PARTITION BY project, severity ORDER BY check_id, title) AS i, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS r FROM f),
  s AS (SELECT project, r, severity, count(*) AS n, '## ' || upper(severity[1]) || severity[2:] || ' (' || count(*) || ')' || chr(10) || chr(10) || string_agg('- **' || title || '** (`' || check_id || '`): ' || coalesce(message, ''), chr(10) ORDER BY i) FILTER (WHERE i <= 20) || CASE WHEN count(*) > 20 THEN chr(10) || '- and ' || (count(*) - 20) || ' more' ELSE '' END AS t FROM r GROUP BY 1, 2, 3)
SELECT project, '# Report: ' || project || chr(10) || chr(10) || sum(n)::BIGINT || ' findings: ' || string_agg(severity || ': ' || n, ' | ' ORDER BY r) || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY r) || chr(10) AS report FROM s GROUP BY 1"""
)
def _markdown_reports(spark, read):
    read("events").createOrReplaceTempView("finding_events")
    return reports.markdown(spark.sql(_FOUND.replace("FROM events", "FROM finding_events")), "project")


@register(
    "WITH m AS (SELECT event_id, 'p' AS project, concat('f', user_id) AS path, event_id AS line_no, CASE WHEN event_id % 5 > 0 THEN CAST(ts AS DATE) END AS day FROM events) SELECT path, line_no, coalesce(datediff('day', day, DATE '2024-03-01'), -1) AS age, CASE WHEN datediff('day', day, DATE '2024-03-01') > 30 THEN 'medium' ELSE 'low' END AS severity FROM m"
)
def _marker_ages(spark, read):
    rows = read("events").select(F.lit("p").alias("project"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("line_no"), F.to_date("ts").alias("day"))
    found = rows.drop("day")
    return code.todo_ages(found, rows.where("line_no % 5 > 0 and day is not null"), F.lit("2024-03-01").cast("date")).select("path", "line_no", F.coalesce(F.col("age").cast("long"), F.lit(-1)).alias("age"), "severity")


@register("SELECT event_id, row_number() OVER (ORDER BY floor(value), event_id) AS by_number, row_number() OVER (ORDER BY ts DESC NULLS LAST, event_id) AS by_time FROM events")
def _listing_positions(spark, read):
    rows = reports.positions(read("events").select("event_id", "ts", F.floor("value").alias("port")), [F.col("port"), F.col("event_id")], "by_number")
    return reports.positions(rows, [F.col("ts").desc_nulls_last(), F.col("event_id")], "by_time").select("event_id", "by_number", "by_time")


_WORD = "regexp_extract(lower(text), '[a-z]+', 0)"


@register(
    f"WITH u AS (SELECT doc_id % 3 AS project, concat('c', doc_id, '.tsx') AS path, concat('card ', {_WORD}) AS name, 1 + doc_id % 2 AS uses FROM documents) SELECT concat('p', project) AS project, name, sum(uses)::BIGINT AS uses, count(*) AS files FROM u GROUP BY 1, 2 HAVING count(*) >= 3 AND sum(uses) >= 3"
)
def _reused_markup(spark, read):
    """Components of one or two boxes named by the text's first word, with the text's words between them."""
    box = f"concat('<section className=\"card ', {_WORD}, '\">', regexp_replace(substr(text, 1, 200), '[^A-Za-z ]', ' '), '</section>')"
    content = f"concat('export function C', doc_id, '() {{ return <main>', {box}, CASE WHEN doc_id % 2 = 1 THEN {box} ELSE '' END, '</main> }}')"
    files = read("documents").select(F.expr("concat('p', doc_id % 3)").alias("project"), F.expr("concat('c', doc_id, '.tsx')").alias("path"), F.expr(content).alias("content"))
    found = interface.reuse(interface.findings(files))
    return found.where(F.col("pattern").contains("card ")).select("project", F.regexp_extract("pattern", "(card [a-z]*)", 1).alias("name"), "uses", "files")
