"""Registered queries over the driver's tables, each with the SQL that DuckDB answers the same with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kestrel.functions import scalars
from kestrel.operators import blocks, code, graph, incremental, patterns, reports, security, shared, state, text, usage, versions
from kestrel.sources import files as trees, parsed
from kestrel.streaming import alerts

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        name = f.__name__.lstrip("_")
        _QUERIES[name] = lambda spark, sf_dir: f(spark, lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _records(read) -> DataFrame:
    return usage.records_from_sales(read("lineitem"), read("part"))


#: The same records and rate card in SQL.
RECORDS = """records AS (SELECT l_orderkey AS session_id, p_brand AS model, l_suppkey AS project_key, CAST(l_quantity AS BIGINT) AS input_tokens,
  CAST(floor(l_extendedprice) AS BIGINT) AS output_tokens, CAST(round(l_discount * 100) AS BIGINT) AS cache_read, CAST(round(l_tax * 100) AS BIGINT) AS cache_write
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
RATES = """rates(model, ri, ro, rr, rw) AS (VALUES ('Brand#11', 3.0::DOUBLE, 15.0::DOUBLE, 0.3::DOUBLE, 3.75::DOUBLE), ('Brand#12', 15.0, 75.0, 1.5, 18.75), ('Brand#13', 0.8, 4.0, 0.08, 1.0))"""
SUMS = "sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write"
COST = "(input_tokens * coalesce(ri, 5.0::DOUBLE) + output_tokens * coalesce(ro, 25.0::DOUBLE) + cache_read * coalesce(rr, 0.5::DOUBLE) + cache_write * coalesce(rw, 6.25::DOUBLE)) / 1e6"


@register(f"WITH {RECORDS}, {RATES}, s AS (SELECT model, {SUMS}, count(*) AS calls FROM records GROUP BY model) SELECT s.*, round({COST}, 4) AS cost_usd FROM s LEFT JOIN rates USING (model)")
def _usage_cost(spark, read):
    return usage.cost_by_model(_records(read), usage.rate_card(spark))


@register(f"WITH {RECORDS} SELECT session_id, model, {SUMS}, count(*) AS calls FROM records GROUP BY ALL")
def _usage_by_session_model(spark, read):
    return usage.by_session_model(_records(read))


@register(f"WITH {RECORDS} SELECT coalesce(model, 'ALL') AS model, {SUMS} FROM records GROUP BY ROLLUP (model)")
def _usage_model_totals(spark, read):
    return usage.model_totals(_records(read))


@register(
    f"WITH {RECORDS} SELECT n_name AS project, sum(input_tokens + output_tokens + cache_write)::BIGINT AS billable, count(DISTINCT session_id) AS sessions "
    "FROM records JOIN supplier ON project_key = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"
)
def _usage_project_breakdown(spark, read):
    owner = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("project_key"), F.col("n_name").alias("project"))
    return usage.project_breakdown(_records(read).join(owner, "project_key"))


@register(
    f"WITH {RECORDS}, {RATES}, s AS (SELECT model, {SUMS} FROM records GROUP BY model) SELECT model, round(coalesce(cache_read * 100.0::DOUBLE / nullif(cache_read + input_tokens + cache_write, 0), 0), 4) AS efficiency, "
    "round(cache_read * (coalesce(ri, 5.0::DOUBLE) - coalesce(rr, 0.5::DOUBLE)) / 1e6, 6) AS saved_usd FROM s LEFT JOIN rates USING (model)"
)
def _usage_cache_efficiency(spark, read):
    return usage.cache_efficiency(_records(read), usage.rate_card(spark))


@register(f"WITH {RECORDS}, {RATES}, s AS (SELECT {SUMS} FROM records) SELECT model, round({COST}, 4) AS cost_usd FROM s, rates")
def _usage_what_if(spark, read):
    return usage.what_if(_records(read), usage.rate_card(spark))


@register(
    f"WITH {RECORDS} SELECT model, {SUMS} FROM records WHERE session_id IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01') GROUP BY model"
)
def _usage_active_sessions(spark, read):
    history = read("orders").where("o_orderdate >= '1995-01-01' AND o_orderdate < '1996-01-01'").select(F.col("o_orderkey").alias("session_id"))
    return usage.active_sessions(_records(read), history).groupBy("model").agg(*(F.sum(c).alias(c) for c in usage.COUNTERS))


@register(
    "SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(n, 0)::BIGINT AS sessions FROM generate_series(DATE '1994-12-01', DATE '1995-03-01', INTERVAL 1 DAY) g(d) "
    "LEFT JOIN (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) o ON o.day = d::DATE"
)
def _usage_daily_series(spark, read):
    daily = read("orders").where("o_orderpriority = '1-URGENT'").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("sessions"))
    return usage.daily_series(daily, "sessions", "1994-12-01", "1995-03-01").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@register(
    "WITH t AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) "
    "SELECT event_id, user_id, event_type, previous FROM t WHERE previous IS NULL OR previous <> event_type"
)
def _state_transitions(spark, read):
    return state.transitions(read("events"), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "user_id", "event_type", "previous")


@register("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def _keep_latest_n(spark, read):
    return state.latest_n(read("events"), "user_id", [F.desc("ts"), F.desc("event_id")], 5).select("event_id", "user_id")


HALVES = "old AS (SELECT user_id, arg_max(value, event_id) AS v FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), new AS (SELECT user_id, arg_max(value, event_id) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND event_type = 'error' GROUP BY 1)"


def _halves(read):
    last = lambda df: df.groupBy("user_id").agg(F.max_by("value", "event_id").alias("v"))
    events = read("events")
    return last(events.where("ts < '2024-01-16'")), last(events.where("ts >= '2024-01-16' AND event_type = 'error'"))


@register(f"WITH {HALVES} SELECT * FROM new UNION ALL SELECT * FROM old WHERE user_id NOT IN (SELECT user_id FROM new)")
def _upsert_latest(spark, read):
    return state.upsert(*_halves(read), ["user_id"])


@register(f"WITH {HALVES} SELECT * FROM old UNION ALL SELECT * FROM new WHERE user_id NOT IN (SELECT user_id FROM old)")
def _insert_ignore(spark, read):
    return state.insert_missing(*_halves(read), ["user_id"])


@register(f"WITH {HALVES} SELECT user_id, coalesce(new.v, old.v) AS v FROM old FULL JOIN new USING (user_id)")
def _upsert_partial(spark, read):
    return state.upsert_partial(*_halves(read), ["user_id"], ["v"])


@register(
    f"WITH {HALVES} SELECT user_id, CASE WHEN old.v IS NULL THEN 'added' WHEN new.v IS NULL THEN 'removed' ELSE 'changed' END AS change, old.v AS old, new.v AS new "
    "FROM old FULL JOIN new USING (user_id) WHERE old.v IS DISTINCT FROM new.v"
)
def _snapshot_diff(spark, read):
    return state.diff(*_halves(read), "user_id", "v")


@register(
    f"WITH {HALVES} SELECT user_id, TIMESTAMP '2024-02-01' AS first_seen, CASE WHEN new.user_id IS NULL THEN TIMESTAMP '2024-02-01' END AS resolved_at FROM new FULL JOIN old USING (user_id) WHERE old.user_id IS NULL "
    "UNION ALL SELECT old.user_id, TIMESTAMP '2024-01-01', CASE WHEN new.user_id IS NULL THEN TIMESTAMP '2024-02-01' END FROM old LEFT JOIN new ON old.user_id = new.user_id"
)
def _scd2_findings(spark, read):
    old, new = _halves(read)
    at = lambda day: F.lit(f"2024-{day}").cast("timestamp_ntz")
    return state.merge_open(old.select("user_id", at("01-01").alias("first_seen")), new, ["user_id"], at("02-01"))


@register(
    "WITH o AS (SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, count(*) AS events, min(ts) AS first, max(ts) AS last FROM g GROUP BY user_id, k"
)
def _debounce_sessions(spark, read):
    return state.debounce(read("events"), "user_id", "ts", "6 hours")


@register(
    "WITH RECURSIVE timed AS (SELECT * FROM events WHERE event_id % 7 <> 0), fired AS (SELECT user_id, event_type, min(ts) AS ts FROM timed GROUP BY 1, 2 UNION ALL "
    "SELECT user_id, event_type, n.ts FROM fired f, LATERAL (SELECT min(e.ts) AS ts FROM timed e WHERE e.user_id = f.user_id AND e.event_type = f.event_type AND e.ts > f.ts + INTERVAL 86400 SECOND) n WHERE n.ts IS NOT NULL) "
    "SELECT user_id, event_type, ts FROM fired"
)
def _alert_cooldown(spark, read):
    known = F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts")  # some alerts have no time
    return state.cooldown(read("events").select("user_id", "event_type", known), ["user_id", "event_type"], "ts", 86400)


@register(
    "WITH RECURSIVE r(user_id, run) AS (SELECT user_id, min(ts) FROM events WHERE ts IS NOT NULL GROUP BY 1 UNION ALL "
    "SELECT r.user_id, greatest(min(e.ts), r.run + INTERVAL 6 HOUR) FROM r JOIN events e ON e.user_id = r.user_id AND e.ts > r.run GROUP BY r.user_id, r.run) SELECT user_id, run FROM r"
)
def _coalesced_runs(spark, read):
    return state.coalesced_runs(read("events"), ["user_id"], "ts", 6 * 3600)


@register(
    "SELECT doc_id, sha256(text) AS digest, length(text) AS chars FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id) WHERE coalesce(toxic, 0) = 0"
)
def _versioned_state(spark, read):
    """A full run over texts that lack their last letters, then a delta to what they are now, without toxic ones."""
    docs = read("documents").select("doc_id", "text")
    store = versions.Store(spark, shared.folder(spark, "versions"), ["doc_id"], "doc_id long, digest string, chars int", 16)
    facts = lambda files: files.select("doc_id", F.length("text").alias("chars"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    cut = F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 40)).otherwise(F.col("text"))
    versions.evaluate(store, docs.withColumn("text", cut), digest, facts)
    toxic = read("labels").where("toxic = 1").select("doc_id")
    version, _ = versions.evaluate(store, docs.join(toxic, "doc_id", "left_anti"), digest, facts)
    return store.read(version)


@register(
    "SELECT doc_id, lower(to_hex(h // 4294967296::HUGEINT)).lpad(8, '0') || lower(to_hex(h % 4294967296::HUGEINT)).lpad(8, '0') AS hash FROM (SELECT doc_id, "
    "list_reduce([14695981039346656037::HUGEINT] || [instr('0123456789abcdef', d[2 * i + 1]) * 16 + instr('0123456789abcdef', d[2 * i + 2]) - 17 FOR i IN range(len(d) // 2)]::HUGEINT[], lambda h, b: xor(h, b) * 1099511628211::HUGEINT % 18446744073709551616::HUGEINT) AS h "
    "FROM (SELECT doc_id, lower(hex(encode(left(text, 40)))) AS d FROM documents))"
)
def _fnv_hash(spark, read):
    """Of each text's first characters: the hash names short keys, such as paths and lines."""
    return read("documents").select("doc_id", scalars.fnv1a_64(F.substring("text", 1, 40)).alias("hash"))


#: The words of all documents, and the most frequent ones of them as popular names.
WORD_NAMES = "words AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM documents), popular AS (SELECT name, row_number() OVER (ORDER BY count(*) DESC, name) AS position FROM words WHERE length(name) > 4 GROUP BY name QUALIFY position <= 300)"


@register(
    f"WITH {WORD_NAMES}, n AS (SELECT DISTINCT name FROM words WHERE length(name) > 3), m AS (SELECT n.name, p.name AS popular, position, levenshtein(n.name, p.name) AS d FROM n JOIN popular p ON abs(length(n.name) - length(p.name)) <= 2 AND levenshtein(n.name, p.name) <= 2) "
    "SELECT name, popular, d > 0 AS squats FROM m QUALIFY row_number() OVER (PARTITION BY name ORDER BY position) = 1"
)
def _typosquat_index(spark, read):
    words = read("documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("name"))
    counted = words.groupBy("name").agg(F.count("*").alias("n"))
    top = counted.where(F.length("name") > 4).orderBy(F.desc("n"), "name").limit(300)
    popular = top.select("name", F.row_number().over(Window.orderBy(F.desc("n"), "name")).alias("position"))  # 300 rows
    return security.typosquats(counted.select("name"), popular)


SEVERITY = "CASE WHEN value >= 90 THEN 'critical' WHEN value >= 70 THEN 'high' WHEN value >= 40 THEN 'medium' ELSE 'low' END"


@register(f"SELECT event_type, {SEVERITY} AS severity, count(*) AS n FROM events GROUP BY 1, 2")
def _severity_histogram(spark, read):
    return read("events").groupBy("event_type", state.severity(F.col("value")).alias("severity")).agg(F.count("*").alias("n"))


@register(f"SELECT user_id, greatest(0, 100 - sum(CASE {SEVERITY} WHEN 'critical' THEN 20 WHEN 'high' THEN 10 WHEN 'medium' THEN 3 ELSE 1 END))::BIGINT AS score FROM events WHERE event_type = 'error' GROUP BY 1")
def _security_score(spark, read):
    return state.security_score(read("events").where("event_type = 'error'").withColumn("severity", state.severity(F.col("value"))), "user_id")


@register("SELECT (hour(ts) * 60 + minute(ts) >= 1320 OR hour(ts) * 60 + minute(ts) < 450) AS quiet, count(*) AS n FROM events GROUP BY 1")
def _quiet_hours(spark, read):
    return read("events").groupBy(state.quiet_hours(F.col("ts"), 1320, 450).alias("quiet")).agg(F.count("*").alias("n"))


LINES = r"lines AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '\r?\n$', ''), '\r?\n') AS a FROM documents))"
NORMALIZED = r"""normalized AS (SELECT doc_id, line_no, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS seq FROM
  (SELECT doc_id, line_no, trim(regexp_replace(line, '[ \t]+', ' ', 'g')) AS line FROM lines) WHERE NOT regexp_matches(line, '^(#|//|import |from )') AND strlen(line) >= 3)"""
WINDOWS = """windows AS (SELECT doc_id, seq, line_no, md5(array_to_string(run, chr(10))) AS hash FROM
  (SELECT doc_id, seq, line_no, list(line) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS run FROM normalized) WHERE len(run) = 3)"""


@register(f"WITH {LINES} SELECT doc_id, line_no, line FROM lines")
def _text_lines(spark, read):
    return text.lines(read("documents"))


@register(f"WITH {LINES}, {NORMALIZED} SELECT doc_id, line_no, line, seq FROM normalized")
def _text_normalized(spark, read):
    return text.normalized(text.lines(read("documents")))


@register(f"WITH {LINES}, {NORMALIZED}, {WINDOWS} SELECT doc_id, seq, line_no, hash FROM windows")
def _dup_windows(spark, read):
    return text.windows(read("documents"), 3)


@register(f"WITH {LINES}, {NORMALIZED}, {WINDOWS} SELECT hash, count(DISTINCT doc_id) AS files, min(doc_id) AS first, count(*) AS places FROM windows GROUP BY hash HAVING count(DISTINCT doc_id) > 1")
def _dup_groups(spark, read):
    return text.duplicate_windows(text.windows(read("documents"), 3))


PATTERNS = [
    patterns.Pattern("license", "(?i)licen[sc]e", ("licen",), True),
    patterns.Pattern("credential", "(?i)(password|token|api_key) *=", ("password", "token", "api_key"), True),
    patterns.Pattern("mail", "[a-z.]+@[a-z0-9.]+", ("@",)),
    patterns.Pattern("number", "[0-9]{3}"),
]
PATTERN_CASE = " ".join(f"WHEN regexp_matches(text, '{p.regex}') THEN '{p.name}'" for p in PATTERNS)


@register(f"SELECT doc_id, CASE {PATTERN_CASE} ELSE 'none' END AS pattern FROM documents")
def _priority_pattern_match(spark, read):
    return read("documents").select("doc_id", patterns.first_match(F.col("text"), PATTERNS, "none").alias("pattern"))


@register(" UNION ALL ".join(f"SELECT doc_id, '{p.name}' AS pattern FROM documents WHERE regexp_matches(text, '{p.regex}')" for p in PATTERNS))
def _all_pattern_match(spark, read):
    return patterns.all_matches(read("documents"), PATTERNS)


@register(
    f"WITH {LINES}, h AS (SELECT doc_id, line_no, CASE WHEN contains(lower(line), 'license') THEN 'license' WHEN contains(lower(line), 'token') THEN 'token' WHEN contains(lower(line), 'mail') THEN 'mail' END AS keyword FROM lines) "
    "SELECT keyword, row_number() OVER (PARTITION BY keyword ORDER BY doc_id, line_no) AS n, doc_id, line_no FROM h WHERE keyword IS NOT NULL QUALIFY n <= 20"
)
def _keyword_search(spark, read):
    return text.keyword_hits(text.lines(read("documents")), ["license", "token", "mail"], 20)


@register(
    f"WITH {LINES}, r AS (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM lines WHERE strlen(line) >= 80) "
    "SELECT doc_id, min(line_no) AS first_line, count(*) AS length FROM r GROUP BY doc_id, island HAVING count(*) >= 3"
)
def _line_islands(spark, read):
    return text.islands(text.lines(read("documents")), F.octet_length("line") >= 80, 3)


@register(
    r"""SELECT page_id, left(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(h, '<!--.*?-->', ' ', 'gs'), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&#160;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')), 50000) AS text FROM (SELECT page_id, html || '<!-- a > b -->x &amp;lt; y&nbsp;z' AS h FROM pages)"""
)
def _html_text(spark, read):
    return read("pages").select("page_id", text.html_text(F.concat("html", F.lit("<!-- a > b -->x &amp;lt; y&nbsp;z"))).alias("text"))


@register(
    """WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+ class="[^"]*")', 1)) AS pattern FROM pages) SELECT pattern, count(*) AS uses, count(DISTINCT page_id) AS pages FROM t GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT page_id) >= 3"""
)
def _reusable_markup(spark, read):
    return text.reusable_markup(read("pages"))


#: Customers and suppliers of one number stand for a module: who buys imports whom it buys from.
EDGES = "edges AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


def _edges(read) -> DataFrame:
    sold = read("orders").join(read("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return sold.select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


@register(f"WITH {EDGES} SELECT dst, count(DISTINCT src) AS importers FROM edges GROUP BY 1 ORDER BY importers DESC, dst LIMIT 5")
def _graph_hubs(spark, read):
    return graph.hubs(_edges(read), 5)


@register(f"WITH {EDGES} SELECT e.src AS a, e.dst AS b FROM edges e JOIN edges f ON e.src = f.dst AND e.dst = f.src WHERE e.src < e.dst")
def _graph_circular(spark, read):
    return graph.mutual(_edges(read))


@register(f"WITH {EDGES} SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT dst FROM edges) AND c_mktsegment <> 'BUILDING'")
def _graph_orphans(spark, read):
    entries = read("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("node"))
    return graph.orphans(read("customer").select(F.col("c_custkey").alias("node")), _edges(read), entries)


# ---- the parts below read documents as source files, events as samples and suppliers as hosts


@register(
    "WITH d AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS orders FROM orders GROUP BY 1) SELECT day, orders, "
    "round((orders - lag(orders) OVER (ORDER BY day)) * 100.0::DOUBLE / lag(orders) OVER (ORDER BY day), 4) AS change, round(orders * 100.0::DOUBLE / max(orders) OVER (), 4) AS bar FROM d"
)
def _usage_trend_dod(spark, read):
    return usage.trend(read("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("orders")), "orders")


def _billable(read) -> DataFrame:
    return read("lineitem").groupBy("l_suppkey").agg(F.sum(F.floor("l_extendedprice")).cast("long").alias("tokens"))


BILLABLE = "billable AS (SELECT l_suppkey, sum(CAST(floor(l_extendedprice) AS BIGINT))::BIGINT AS tokens FROM lineitem GROUP BY 1)"


@register(f"WITH {BILLABLE} SELECT l_suppkey, tokens, CASE WHEN tokens <= 50000 THEN 1 WHEN tokens <= 150000 THEN 2 WHEN tokens <= 500000 THEN 3 ELSE 4 END AS level FROM billable")
def _usage_levels(spark, read):
    return _billable(read).withColumn("level", scalars.usage_level(F.col("tokens")))


@register(f"WITH {BILLABLE} SELECT l_suppkey AS subject, 'usage' AS rule, s AS severity, tokens::VARCHAR AS detail FROM billable, (VALUES ('warning', 800000), ('critical', 2000000)) t(s, n) WHERE tokens > n")
def _usage_thresholds(spark, read):
    return security.usage_alerts(_billable(read), "l_suppkey", "tokens")


@register("SELECT conv_id, turn, text FROM conversations WHERE role = 'user' ORDER BY conv_id DESC, turn DESC, text LIMIT 50")
def _prompts_recent(spark, read):
    return reports.capped(read("conversations").where("role = 'user'").select("conv_id", "turn", "text"), 50, [F.desc("conv_id"), F.desc("turn"), F.col("text")])


@register("SELECT conv_id, turn, role FROM (SELECT DISTINCT conv_id, turn, role FROM conversations) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) <= 3")
def _tail_of_stream(spark, read):
    rows = read("conversations").select("conv_id", "turn", "role").distinct().withColumn("at", F.struct("turn", "role"))
    return parsed.tail(rows, "conv_id", "at", 3).drop("at")


def _files(read, content: Column | None = None) -> DataFrame:
    content = F.col("text") if content is None else content
    return read("documents").select(F.col("source").alias("project"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), content.alias("content"))


FILES = "files AS (SELECT source AS project, doc_id || '.txt' AS path, text AS content FROM documents)"
FILE_LINES = r"file_lines AS (SELECT project, path, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS line FROM (SELECT project, path, string_split_regex(regexp_replace(content, '\r?\n$', ''), '\r?\n') AS a FROM files))"


@register(
    f"WITH {FILES}, n AS (SELECT project, path, len(list_filter(string_split_regex(content, '\\r?\\n'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')) AS lines FROM files) "
    "SELECT project, path, lines, 0::BIGINT AS functions, 0::BIGINT AS classes, CASE WHEN lines > 40 THEN 'critical' WHEN lines > 20 THEN 'high' ELSE 'medium' END AS severity FROM n WHERE lines > 10"
)
def _monster_docs(spark, read):
    none = spark.createDataFrame([], code.FACTS)
    return code.large_files(_files(read), none, critical=40, high=20, medium=10)


@register(
    f"WITH files AS (SELECT source AS project, doc_id || '.txt' AS path, regexp_replace(CASE WHEN lang = 'de' THEN '# TODO: ' ELSE '// see fixme ' END || text, '\\r?\\n(.)', chr(10) || '// hack: \\1', 'g') AS content FROM documents), {FILE_LINES}, t AS (SELECT project, path, line_no, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM file_lines) SELECT project, path, line_no, upper(regexp_extract(line, '(?i)\\b(TODO|FIXME|HACK|XXX|TEMP)\\b(.*)', 1)) AS kind, "
    "trim(regexp_replace(trim(regexp_extract(line, '(?i)\\b(TODO|FIXME|HACK|XXX|TEMP)\\b(.*)', 2)), '^:+', '')) AS text FROM t WHERE regexp_matches(line, '^#|^//|# |// ') AND regexp_matches(line, '(?i)\\b(TODO|FIXME|HACK|XXX|TEMP)\\b')"
)
def _marker_scan(spark, read):
    mark = F.when(F.col("lang") == "de", "# TODO: ").otherwise("// see fixme ")  # the texts hold no markers of their own
    return code.todos(_files(read, F.regexp_replace(F.concat(mark, "text"), "\r?\n(.)", "\n// hack: $1")))


PLAIN = "|".join(h.replace(".", "[.]") for h in code.PLAIN_HOSTS)


@register(
    f"SELECT 'pages' AS project, page_id || '.js' AS path, 1::BIGINT AS line_no, 'url' AS kind, url AS value FROM pages WHERE NOT regexp_matches(url, '{PLAIN}') "
    "UNION ALL SELECT 'pages', page_id || '.js', 1, 'sleep', (page_id % 40)::VARCHAR FROM pages WHERE page_id % 40 > 10 "
    "UNION ALL SELECT 'pages', page_id || '.js', 2, 'timeout', (page_id * 100)::VARCHAR FROM pages WHERE page_id * 100 > 10000"
)
def _hardcoded_values(spark, read):
    script = F.format_string("fetch('%s'); sleep(%d)\nsetTimeout(f, %d)\n// fetch('http://left.out')", "url", F.col("page_id") % 40, F.col("page_id") * 100)
    return code.hardcoded(read("pages").select(F.lit("pages").alias("project"), F.concat(F.col("page_id").cast("string"), F.lit(".js")).alias("path"), script.alias("content")))


#: A generic shape besides the vendors': the tables hold made-up credentials.
GENERIC = patterns.Pattern("Assigned secret", "(?i)(password|token|api_key) *=", ("password", "token", "api_key"), True)
CREDENTIAL_CASE = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p, *_ in [*security.CREDENTIALS, GENERIC])
CREDENTIALS_SQL = f"c AS (SELECT doc_id, CASE {CREDENTIAL_CASE} END AS detail FROM documents)"


@register(f"WITH {CREDENTIALS_SQL} SELECT doc_id AS subject, 'credential' AS rule, 'high' AS severity, detail FROM c WHERE detail IS NOT NULL")
def _secrets_scan(spark, read):
    return security.credentials(read("documents"), "doc_id", "text", [GENERIC])


@register(f"WITH {CREDENTIALS_SQL} SELECT quality, toxic, count(*) AS docs, count(detail) AS found FROM labels JOIN c USING (doc_id) GROUP BY 1, 2")
def _detector_accuracy(spark, read):
    found = security.credentials(read("documents"), "doc_id", "text", [GENERIC]).select(F.col("subject").alias("doc_id"), "detail")
    known = read("labels").join(read("documents").select("doc_id"), "doc_id").join(found, "doc_id", "left")
    return known.groupBy("quality", "toxic").agg(F.count("*").alias("docs"), F.count("detail").alias("found"))


@register("SELECT doc_id, CASE WHEN regexp_matches(text, '[Ѐ-ӿ]') THEN 'uk' ELSE 'en' END AS language FROM documents")
def _lang_detect(spark, read):
    return read("documents").select("doc_id", scalars.language(F.col("text")).alias("language"))


@register(
    f"WITH {LINES}, {NORMALIZED}, {WINDOWS}, p AS (SELECT hash, doc_id AS first, seq AS first_seq, line_no AS first_line FROM windows QUALIFY row_number() OVER (PARTITION BY hash ORDER BY doc_id, seq) = 1) "
    "SELECT hash, first, first_seq, first_line, doc_id, seq, line_no FROM windows JOIN p USING (hash) WHERE doc_id <> first"
)
def _dup_pairs(spark, read):
    return text.duplicate_places(text.windows(read("documents"), 3))


@register(
    f"WITH {LINES}, {NORMALIZED}, {WINDOWS}, p AS (SELECT hash, doc_id AS first, seq AS first_seq, line_no AS first_line FROM windows QUALIFY row_number() OVER (PARTITION BY hash ORDER BY doc_id, seq) = 1), "
    "m AS (SELECT doc_id, seq, line_no, first, first_line, seq - first_seq AS diagonal, seq - row_number() OVER (PARTITION BY first, doc_id, seq - first_seq ORDER BY seq) AS island FROM windows JOIN p USING (hash) WHERE doc_id <> first) "
    "SELECT first, doc_id, min(first_line) AS first_line, min(line_no) AS line, count(*) + 2 AS length FROM m GROUP BY first, doc_id, diagonal, island"
)
def _dup_blocks(spark, read):
    return text.duplicate_blocks(text.windows(read("documents"), 3), 3)


#: All lengths of every repeated run, one line at a time; blocks are what branches on both sides.
WHOLE_BLOCKS = """w AS (SELECT * FROM windows WHERE hash IN (SELECT hash FROM windows GROUP BY hash HAVING count(DISTINCT doc_id) > 1)),
  runs(n, doc_id, seq, name) AS (SELECT 1, doc_id, seq, hash FROM w UNION ALL SELECT n + 1, runs.doc_id, runs.seq, md5(name || hash) FROM runs JOIN w ON w.doc_id = runs.doc_id AND w.seq = runs.seq + n),
  r AS (SELECT a.n, a.doc_id, a.seq, a.name, coalesce(b.name, a.doc_id || '/' || a.seq) AS after, coalesce(p.hash, a.doc_id || '/' || a.seq) AS before
    FROM runs a LEFT JOIN runs b ON b.n = a.n + 1 AND b.doc_id = a.doc_id AND b.seq = a.seq LEFT JOIN w p ON p.doc_id = a.doc_id AND p.seq = a.seq - 1),
  b AS (SELECT n, name, min({'d': doc_id, 's': seq}) AS f, count(*) AS places FROM r GROUP BY n, name HAVING min(doc_id) <> max(doc_id) AND min(after) <> max(after) AND min(before) <> max(before)),
  held AS (SELECT r.doc_id, r.seq, b.* FROM r JOIN b USING (n, name)),
  own AS (SELECT doc_id, seq, f, n FROM held QUALIFY row_number() OVER (PARTITION BY doc_id, seq ORDER BY n DESC) = 1),
  up AS (SELECT f, n, places, lag(f) OVER c AS sf, lag(n) OVER c AS sn FROM held WINDOW c AS (PARTITION BY doc_id, seq ORDER BY n) QUALIFY doc_id = f.d AND seq = f.s)"""


@register(
    f"WITH RECURSIVE {LINES}, {NORMALIZED}, {WINDOWS}, {WHOLE_BLOCKS} SELECT up.f.d AS first, up.f.s AS first_seq, l.line_no AS first_line, (up.n + 2)::BIGINT AS length, places, up.sf.d AS shorter_first, up.sf.s AS shorter_seq, (up.sn + 2)::BIGINT AS shorter_length, o.doc_id, o.seq, o.line_no "
    "FROM up JOIN windows l ON l.doc_id = up.f.d AND l.seq = up.f.s LEFT JOIN (SELECT own.*, line_no FROM own JOIN windows USING (doc_id, seq)) o ON o.f = up.f AND o.n = up.n"
)
def _whole_blocks(spark, read):
    return blocks.listed(*blocks.whole_blocks(text.windows(read("documents"), 3), 3))


@register(f"WITH {LINES} SELECT doc_id, line_no, last_value(CASE WHEN length(line) < 60 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM lines")
def _section_forward_fill(spark, read):
    return text.section_fill(text.lines(read("documents")), F.length("line") < 60).select("doc_id", "line_no", "section")


@register(f"WITH {LINES}, n AS (SELECT *, max(contains(line, 'token')) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS near FROM lines) SELECT doc_id, line_no FROM n WHERE contains(line, 'License') AND NOT near")
def _lookahead_missing(spark, read):
    return text.lookahead_missing(text.lines(read("documents")), "License", "token").select("doc_id", "line_no")


WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM"


@register(f"SELECT name FROM ({WORDS} benchmark) WHERE name NOT IN ({WORDS} documents)")
def _unused_words(spark, read):
    words = lambda t: read(t).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("name"))
    return text.unused(words("benchmark").distinct(), words("documents"), ["name"])


@register("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-23'")
def _retention_filter(spark, read):
    return alerts.retained(read("events"), F.lit("2024-01-30").cast("timestamp_ntz"), 7).select("event_id", "ts")


DAYS = "old AS (SELECT DISTINCT user_id FROM events WHERE ts < TIMESTAMP '2024-01-01 06:00:00'), new AS (SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 18:00:00')"


@register(f"WITH {DAYS} SELECT user_id, 'up' AS event FROM new WHERE user_id NOT IN (FROM old) UNION ALL SELECT user_id, 'down' FROM old WHERE user_id NOT IN (FROM new)")
def _up_down_events(spark, read):
    return reports.up_down(read("events").where("ts < '2024-01-01 06:00:00'"), read("events").where("ts >= '2024-01-30 18:00:00'"), ["user_id"])


@register("SELECT event_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 95)")
def _new_findings_only(spark, read):
    seen = read("events").where("event_type = 'purchase' AND value > 95")
    return reports.new_only(read("events").where("event_type = 'error'"), seen, ["user_id"]).select("event_id")


@register(f"SELECT {SEVERITY} AS severity, event_type AS category, count(*) AS n FROM events GROUP BY 1, 2")
def _action_plan(spark, read):
    return reports.action_plan(read("events").select(state.severity(F.col("value")).alias("severity"), F.concat("event_type", F.lit(".x")).alias("check_id")))


@register("SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def _dedup_first_wins(spark, read):
    return reports.first_of(read("events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "ts")


@register("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_name, s_suppkey), s_name FROM supplier")
def _append_identity(spark, read):
    base = read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return reports.append_numbered(base, read("supplier").select(F.col("s_name").alias("name"), "s_suppkey"), "id", [F.col("name"), F.col("s_suppkey")])


@register("SELECT (value * 10)::BIGINT AS port, count(*) AS listeners FROM (SELECT floor(value) AS value FROM events) GROUP BY 1 HAVING count(*) > 1")
def _port_conflicts(spark, read):
    return security.port_conflicts(read("events").select((F.floor("value") * 10).cast("long").alias("port")))


@register(
    "SELECT user_id AS name, 'container.exited' AS rule, event_id FROM events WHERE event_type = 'error' UNION ALL SELECT user_id, 'container.cpu', event_id FROM events WHERE event_type <> 'error' AND value > 80 "
    "UNION ALL SELECT user_id, 'container.ram', event_id FROM events WHERE event_type <> 'error' AND value * 100.0 / 100 > 85"
)
def _container_alerts(spark, read):
    samples = read("events").select(
        F.struct("user_id", "event_id").alias("name"), F.when(F.col("event_type") == "error", "exited").otherwise("running").alias("status"), F.lit(1).alias("exit_code"), F.col("value").alias("cpu_percent"),
        F.col("value").alias("mem_usage"), F.lit(100).alias("mem_limit"), F.lit("healthy").alias("health"), F.lit(0).alias("restart_count"),
    )
    return security.container_alerts(samples).select(F.col("subject.user_id").alias("name"), "rule", F.col("subject.event_id").alias("event_id"))


REMOTE = ", ".join(f"({p}, '{s}')" for p, s in security.REMOTE_PORTS.items())
LISTENERS = ", ".join(f"({p}, '{s}')" for p, s in security.RISKY_LISTENERS.items())


@register(
    f"WITH r(port, severity) AS (VALUES {REMOTE}), l(port, service) AS (VALUES {LISTENERS}), s AS (SELECT s_suppkey * 111 AS port, '8.8.0.' || s_nationkey AS ip FROM supplier) "
    "SELECT DISTINCT ip || ':' || port AS subject, 'network.remote_port' AS rule, severity, port::VARCHAR AS detail FROM s JOIN r USING (port) "
    "UNION ALL SELECT DISTINCT '0.0.0.0:' || p, 'network.listener', 'high', service FROM (SELECT s_suppkey * 100 AS p FROM supplier) JOIN l ON p = port"
)
def _network_findings(spark, read):
    at = read("supplier").select("s_suppkey", F.concat(F.lit("8.8.0."), F.col("s_nationkey").cast("string")).alias("remote_ip"))
    out = at.select(F.lit("10.0.0.1").alias("local_ip"), F.lit(1).cast("long").alias("local_port"), "remote_ip", (F.col("s_suppkey") * 111).alias("remote_port"), F.lit("01").alias("state"))
    heard = at.select(F.lit("0.0.0.0"), F.col("s_suppkey") * 100, F.lit("0.0.0.0"), F.lit(0).cast("long"), F.lit("0A"))
    return security.connections(out.union(heard))


@register("SELECT s_suppkey, (s_suppkey % 256) || '.' || (s_suppkey // 256 % 256) || '.' || (s_suppkey // 65536 % 256) || '.' || (s_suppkey // 16777216 % 256) AS ip, s_nationkey::BIGINT AS port FROM supplier")
def _hex_addr_decode(spark, read):
    address = F.format_string("%08X:%04X", "s_suppkey", "s_nationkey")
    return read("supplier").select("s_suppkey", scalars.hex_address(address).alias("a")).select("s_suppkey", "a.ip", "a.port")


@register("SELECT s_suppkey, (s_suppkey & 2) <> 0 AS writable, (s_suppkey & 4) <> 0 AS readable FROM supplier")
def _permission_bits(spark, read):
    return read("supplier").select("s_suppkey", scalars.has_bits(F.col("s_suppkey"), 2).alias("writable"), scalars.has_bits(F.col("s_suppkey"), 4).alias("readable"))


@register(
    "WITH v AS (SELECT p_partkey, p_size // 10 AS a, p_size % 10 AS b FROM part) SELECT p_partkey, CASE WHEN a < 3 THEN 'high' WHEN a = 3 AND b < 5 THEN 'medium' WHEN a = 3 AND b = 5 THEN 'low' END AS gap FROM v"
)
def _version_gap(spark, read):
    current = F.concat(F.lit("^"), F.floor(F.col("p_size") / 10).cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string"), F.lit(".0"))
    return read("part").select("p_partkey", scalars.version_gap(current, F.lit("3.5.1")).alias("gap"))


#: Two versions of the documents: before, Spanish ones were missing and German ones in capitals.
def _versions(read) -> tuple[DataFrame, DataFrame]:
    docs = read("documents")
    of = lambda df, content: df.select(F.col("source").alias("project"), F.col("doc_id").cast("string").alias("path"), content.alias("content"))
    return of(docs.where("lang <> 'es'"), F.when(F.col("lang") == "de", F.upper("text")).otherwise(F.col("text"))), of(docs, F.col("text"))


@register(
    "SELECT source AS project, doc_id::VARCHAR AS path, CASE WHEN lang = 'de' THEN 'modified' ELSE 'added' END AS change FROM documents WHERE lang IS NULL OR lang = 'es' OR (lang = 'de' AND upper(text) <> text)"
)
def _delta_plan(spark, read):
    old, new = _versions(read)
    return incremental.plan(incremental.digests(old), new)


@register("SELECT source AS project, doc_id::VARCHAR AS path, sha256(coalesce(text, '')) AS digest FROM documents")
def _delta_carry_over(spark, read):
    old, new = _versions(read)
    state_before = incremental.digests(old)
    return incremental.carry_over(state_before, incremental.plan(state_before, new), new, incremental.digests)


@register("SELECT source AS feature, count(*) AS files FROM documents GROUP BY 1")
def _feature_groups(spark, read):
    return trees.features(read("documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path")))


@register(f"SELECT user_id AS path, count(*) AS n, arg_min(s, r) AS worst FROM (SELECT user_id, {SEVERITY} AS s, CASE {SEVERITY} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS r FROM events) GROUP BY 1")
def _findings_by_file(spark, read):
    found = read("events").select(F.col("user_id").alias("path"), state.severity(F.col("value")).alias("severity"), F.col("event_type").alias("title"))
    return reports.by_file(found).select("path", "n", "worst")
