import datetime as dt

import pytest
from pyspark.sql import functions as F

from kestrel.operators import code, incremental, reports, state
from kestrel.streaming import alerts

T0 = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_delta_equals_full(spark):
    schema = "project string, path string, content string"
    old = spark.createDataFrame([("p", "a.py", "# TODO one"), ("p", "b.py", "# TODO two"), ("p", "c.py", "# FIXME x"), ("p", "e.py", None)], schema)
    new = spark.createDataFrame([("p", "a.py", "# TODO one"), ("p", "b.py", "\n# HACK two"), ("p", "d.py", "# XXX y"), ("p", "e.py", "")], schema)
    changes = incremental.plan(incremental.digests(old), new)
    assert rows(changes) == [("p", "b.py", "modified"), ("p", "c.py", "deleted"), ("p", "d.py", "added")]
    assert rows(incremental.carry_over(code.todos(old), changes, new, code.todos)) == rows(code.todos(new))
    assert rows(incremental.carry_over(code.facts(old), changes, new, code.facts)) == rows(code.facts(new))


def test_promises_without_catch(spark):
    text = "a.then(f)\nb\nc\nd\ne.then(f).catch(g)\nh\n.then(k)\n\n\n  .catch(z)"
    files = spark.createDataFrame([("p", "a.js", text)], "project string, path string, content string")
    assert rows(code.error_gaps(files, code.facts(files))) == [("p", "a.js", 1, "then_no_catch")]


def test_cache_lookup(spark):
    cached = spark.createDataFrame([("p", "c2"), ("p", "c9")], "project string, hash string")
    line = spark.createDataFrame([("p", f"c{i}", i) for i in range(60)], "project string, hash string, depth int")
    assert rows(incremental.nearest_cached(cached, line)) == [("p", "c2", 2)]
    stored = spark.createDataFrame([("p", "h", 1), ("q", "h", 1), ("r", "h", 0)], "project string, hash string, version int")
    heads = spark.createDataFrame([("p", "h", ["out/x"]), ("q", "h", ["a.py"]), ("r", "h", [])], "project string, hash string, dirty array<string>")
    assert [r.project for r in incremental.exact_hits(stored, heads, 1, "out/").collect()] == ["p"]


FINDINGS = [("a.py", "dead.x", "low", "t1", "m"), ("a.py", "debt.y", "high", "t2", None), ("b.py", "dead.x", "low", "t3", "m")]


def test_reports(spark):
    df = spark.createDataFrame(FINDINGS, "path string, check_id string, severity string, title string, message string")
    assert [tuple(r) for r in reports.action_plan(df).collect()] == [("high", "debt", 1), ("low", "dead", 2)]
    assert rows(reports.by_file(df)) == [("a.py", 2, "high", ["t2", "t1"]), ("b.py", 1, "low", ["t3"])]
    text = {r.path: r.report for r in reports.markdown(df, "path").collect()}["a.py"]
    assert text.startswith("# Report: a.py\n\n2 findings: high: 1 | low: 1\n") and text.index("## High (1)") < text.index("## Low (1)")
    assert reports.select(df, prefix="dead.").count() == 2 and reports.select(df, severity="high").count() == 1
    assert reports.payload(df.where("title = 't2'")).first().json == '{"path":"a.py","check_id":"debt.y","severity":"high","title":"t2"}'
    assert rows(reports.up_down(df.limit(2), df, ["path"])) == [("b.py", "up")]


def test_managed_section(spark):
    mark = "<!-- k:start -->\n{}\n<!-- k:end -->"
    df = spark.createDataFrame([("top\n" + mark.format("old") + "\nend",), ("top",), ("",)], "t string")
    got = [r[0] for r in df.select(reports.replace_section(F.col("t"), "k", F.lit("new"))).collect()]
    assert got == ["top\n" + mark.format("new") + "\nend", "top\n\n" + mark.format("new") + "\n", mark.format("new") + "\n"]


def test_numbers_go_on(spark):
    base = spark.createDataFrame([(7, 1.0)], "id long, v double")
    got = rows(reports.append_numbered(base, spark.range(100).select((F.col("id") * 0.5).alias("v")), "id", [F.col("v")]))
    assert sorted(got)[1:] == [(8 + i, i * 0.5) for i in range(100)]


def test_partitions_are_replaced(spark, tmp_path):
    write = lambda rows: reports.replace_partitions(spark.createDataFrame(rows, "k int, day string"), str(tmp_path / "t"), ["day"])
    write([(1, "a"), (2, "b")])
    write([(3, "b")])
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == [(1, "a"), (3, "b")]


def run(df, tmp_path, mode="append"):
    name = "q" + tmp_path.name.replace("-", "_")
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return df.sparkSession.table(name)


def stream(spark, tmp_path, rows, schema):
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))


def test_stream_cooldown(spark, tmp_path):
    at = [("a", T0 + dt.timedelta(seconds=s)) for s in (0, 200, 301, 500, 602)] + [("b", T0), ("d", T0)]
    df = stream(spark, tmp_path, at, "k string, ts timestamp")
    fired = alerts.cooldown(df, ["k"], dismissed=spark.createDataFrame([("d",)], "k string"))
    assert sorted((r.k, (r.ts - T0).total_seconds()) for r in run(fired, tmp_path).collect()) == [("a", 0), ("a", 301), ("a", 602), ("b", 0)]


def test_stream_transitions(spark, tmp_path):
    at = [("a", s, T0 + dt.timedelta(seconds=i)) for i, s in enumerate("xxyyx")]
    df = stream(spark, tmp_path, at, "k string, s string, ts timestamp")
    assert sorted((r.ts - T0).total_seconds() for r in run(alerts.transitions(df, ["k"], "s"), tmp_path).collect()) == [0, 2, 4]


def test_sinks(spark, tmp_path):
    events = []
    sink = alerts.diff_sink(str(tmp_path / "s"), ["port"], lambda df: events.append(rows(df)))
    for n, ports in enumerate([[1, 2], [2, 3], [2, 3]]):
        sink(spark.createDataFrame([(p,) for p in ports], "port int"), n)
    assert events == [[(1, "up"), (2, "up")], [(1, "down"), (3, "up")], []]
    sink = alerts.upsert_sink(str(tmp_path / "u"), ["day", "k"], "day")
    for n, batch in enumerate([[("d1", 1, 10), ("d2", 1, 5)], [("d1", 1, 11), ("d1", 2, 7)]]):
        sink(spark.createDataFrame(batch, "day string, k int, v int"), n)
    assert rows(spark.read.parquet(str(tmp_path / "u")).select("day", "k", "v")) == [("d1", 1, 11), ("d1", 2, 7), ("d2", 1, 5)]


def test_reruns_coalesce():
    assert alerts.coalesced([(0, 10), (1, 10), (2, 10), (30, 5)]) == [0, 10, 30]
    assert alerts.coalesced([(0, 10), (1, 10)]) == [0, 10]


def test_requests_during_a_run_make_one_more(spark, tmp_path):
    pick = __import__("random").Random(3)
    times = sorted(pick.randrange(400) for _ in range(60))
    want, busy = [], None
    for t in times:  # a run at a time
        if busy is None or t >= busy + 10:
            busy = t
        elif t > busy:
            busy += 10
        else:
            continue
        want.append(busy)
    rows_ = [("a", T0 + dt.timedelta(seconds=t)) for t in times] + [("a", None), ("b", T0)]
    second = lambda df: sorted((r.k, (r.run - T0).total_seconds()) for r in df.collect())
    assert second(state.coalesced_runs(spark.createDataFrame(rows_, "k string, ts timestamp"), ["k"], "ts", 10)) == [*(("a", t) for t in want), ("b", 0)]
    df = stream(spark, tmp_path, [r for r in rows_ if r[1]][-9:], "k string, ts timestamp")
    found = second(run(alerts.coalesced_runs(df, ["k"], 10), tmp_path))
    last = spark.createDataFrame([r for r in rows_ if r[1]][-9:], "k string, ts timestamp")
    assert found == second(state.coalesced_runs(last, ["k"], "ts", 10))


def test_old_keys_leave_the_state(spark, tmp_path):
    """A batch a file: the watermark passes the cooldown of a and b, whose state goes; c's stays."""
    at = [("a", T0), ("b", T0), ("c", T0 + dt.timedelta(hours=3)), ("c", T0 + dt.timedelta(hours=3, seconds=1)), ("c", T0 + dt.timedelta(hours=3, seconds=2))]
    for r in at:
        spark.createDataFrame([r], "k string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fired = run(alerts.cooldown(df, ["k"]), tmp_path)
    assert sorted(r.k for r in fired.collect()) == ["a", "b", "c"]
    kept = spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "last").load()
    assert {r.key.k for r in kept.select("key").collect()} == {"c"}


def test_restart_gives_each_row_once(spark, tmp_path):
    """A batch breaks off after its rows were written; the query that starts again runs it anew, with the state it had."""
    at = [("a", T0 + dt.timedelta(seconds=s)) for s in (0, 200, 301, 500, 602, 700, 910)]
    df = stream(spark, tmp_path, at, "k string, ts timestamp")
    sink, out, broken = alerts.once_sink(str(tmp_path / "out")), [], []

    def once_broken(batch, number):
        sink(batch, number)
        out.append(number)
        if number == 1 and not broken:
            broken.append(number)
            raise RuntimeError("lost")

    def start():
        query = alerts.cooldown(df, ["k"]).writeStream.foreachBatch(once_broken).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        return query.awaitTermination(120)

    with pytest.raises(Exception, match="lost"):
        start()
    start()
    assert out.count(1) == 2
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.ts - T0).total_seconds() for r in got.collect()) == [0, 301, 602, 910]


def test_sinks_take_a_batch_twice(spark, tmp_path):
    events = []
    sink = alerts.diff_sink(str(tmp_path / "s"), ["port"], lambda df: events.append(rows(df)))
    for n, ports in ((0, [1, 2]), (1, [2, 3]), (1, [2, 3]), (2, [3])):
        sink(spark.createDataFrame([(p,) for p in ports], "port int"), n)
    assert events == [[(1, "up"), (2, "up")], [(1, "down"), (3, "up")], [(1, "down"), (3, "up")], [(2, "down")]]
    sink = alerts.upsert_sink(str(tmp_path / "u"), ["day", "k"], "day")
    for n, batch in ((0, [("d1", 1, 10)]), (1, [("d1", 1, 11), ("d2", 2, 7)]), (1, [("d1", 1, 11), ("d2", 2, 7)])):
        sink(spark.createDataFrame(batch, "day string, k int, v int"), n)
    assert rows(spark.read.parquet(str(tmp_path / "u")).select("day", "k", "v")) == [("d1", 1, 11), ("d2", 2, 7)]


def test_grace_and_throttle(spark):
    at = spark.createDataFrame([(T0 + dt.timedelta(seconds=s),) for s in (0, 14, 15, 16)] + [(None,)], "ts timestamp")
    assert [(r.ts - T0).total_seconds() for r in alerts.startup_grace(at, T0).orderBy("ts").collect()] == [15, 16]
    calls = at.where("ts is not null").select(F.lit("call").alias("k"), "ts")
    assert [(r.ts - T0).total_seconds() for r in state.cooldown(calls, ["k"], "ts", 5).orderBy("ts").collect()] == [0, 14]
