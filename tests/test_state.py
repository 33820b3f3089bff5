import datetime as dt

from pyspark.sql import functions as F

from kestrel.operators import graph, state, text

T0 = dt.datetime(2024, 1, 1)


def test_cooldown_counts_from_the_last_fired(spark):
    rows = [("a", T0 + dt.timedelta(seconds=s)) for s in (0, 200, 300, 301, 500, 602)] + [("b", T0)]
    fired = state.cooldown(spark.createDataFrame(rows, "k string, ts timestamp"), ["k"], "ts", 300)
    assert sorted((r.k, (r.ts - T0).total_seconds()) for r in fired.collect()) == [("a", 0), ("a", 301), ("a", 602), ("b", 0)]


def test_transitions_keep_the_first(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate("xxyyx")], "k int, i int, s string")
    assert [r.i for r in state.transitions(rows, "k", "s", ["i"]).orderBy("i").collect()] == [0, 2, 4]


def test_cooldown_leaves_null_times_aside(spark):
    rows = [("a", None), ("a", T0), ("a", T0 + dt.timedelta(hours=50)), (None, T0), (None, T0 + dt.timedelta(seconds=1))]
    fired = state.cooldown(spark.createDataFrame(rows, "k string, ts timestamp"), ["k"], "ts", 300).collect()
    assert sorted(((r.k, (r.ts - T0).total_seconds()) for r in fired), key=repr) == sorted([("a", 0), ("a", 180_000), (None, 0)], key=repr)


def test_cooldown_over_many_batches(spark):
    pick = __import__("random").Random(4)
    rows = [(i % 3, T0 + dt.timedelta(seconds=pick.randrange(90_000))) for i in range(4000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        fired = state.cooldown(spark.createDataFrame(rows, "k int, ts timestamp"), ["k"], "ts", 300).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for k in range(3):
        last = None
        for t in sorted(t for j, t in rows if j == k):
            if last is None or t - last > dt.timedelta(seconds=300):
                want.append((k, t))
                last = t
    assert sorted((r.k, r.ts) for r in fired) == want


def test_cooldown_of_one_key_over_all_ranges(spark):
    """The alerts of a constant key lie in every range, those of others begin or end at borders; ties and gaps of all sizes."""
    pick = __import__("random").Random(5)
    for step, keys in ((90, 1), (3, 1), (600, 1), (40, 3), (2000, 9)):
        rows, at = [], 0
        for i in range(1500):
            at += pick.choice([0, 1, step, pick.randrange(step)])
            rows.append((pick.randrange(keys), i, T0 + dt.timedelta(seconds=at)))
        got = state.cooldown(spark.createDataFrame(rows, "k int, i int, ts timestamp"), ["k"], "ts", 300)
        want, last = [], {}
        for k, _, t in sorted(rows, key=lambda r: (r[0], r[2])):
            if k not in last or t - last[k] > dt.timedelta(seconds=300):
                want.append((k, t))
                last[k] = t
        assert sorted((r.k, r.ts) for r in got.collect()) == want
    assert state.cooldown(spark.createDataFrame([], "k int, ts timestamp"), ["k"], "ts", 300).count() == 0


def test_passage_of_a_chunk():
    import numpy as np

    pick = np.random.default_rng(1)
    for _ in range(300):
        times = np.sort(pick.integers(0, 300, pick.integers(1, 40)))
        pause = int(pick.integers(1, 120))
        bounds, results = state._passage(times, pause)
        for last in [state._NEVER, *range(int(times[0]) - 150, int(times[0]) + 1)]:
            found = results[0 if last == state._NEVER else int(np.asarray(bounds, np.int64).searchsorted(last + pause, "right"))]
            assert (last if found == state._NEVER else found) == state._fires(times, pause, last)[1]


def test_transitions_to_and_from_null(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(["x", None, None, "x", "x"])] + [(2, 0, None), (2, 1, None)], "k int, i int, s string")
    assert sorted((r.k, r.i) for r in state.transitions(rows, "k", "s", ["i"]).collect()) == [(1, 0), (1, 1), (1, 3), (2, 0)]


def test_upserts_of_repeated_keys(spark):
    base = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    changes = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (3, "c", 1), (3, "d", 2)], "k int, v string, at int")
    newest = [F.desc("at")]
    assert sorted(map(tuple, state.upsert(base, changes, ["k"], newest).collect())) == [(1, "b"), (2, "old"), (3, "d")]
    assert sorted(map(tuple, state.upsert_partial(base, changes, ["k"], ["v"], newest).collect())) == [(1, "b"), (2, "old"), (3, "d")]
    assert sorted(map(tuple, state.insert_missing(base, changes, ["k"], [F.col("at")]).collect())) == [(1, "old"), (2, "old"), (3, "c")]


def test_html_text(spark):
    page = spark.createDataFrame([("<title> A &amp; B </title><!-- x > y --><p>a &amp; b&nbsp;&lt;c&gt;</p><script>no()</script>",)], "html string")
    assert page.select(text.html_title(F.col("html")), text.html_text(F.col("html")), text.html_text(F.col("html"), 3)).first()[:] == ("A & B", "A & B a & b <c>", "A &")


def test_quiet_hours_wrap(spark):
    rows = spark.createDataFrame([(T0 + dt.timedelta(hours=h),) for h in (23, 3, 12)], "ts timestamp")
    assert [r[0] for r in rows.select(state.quiet_hours(F.col("ts"), 1320, 420)).collect()] == [True, True, False]


def test_mutual_imports(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("a", "a")], "src string, dst string")
    assert [tuple(r) for r in graph.mutual(edges).collect()] == [("a", "b")]


def test_lines_and_windows_of_empty_input(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert text.windows(empty, 3).count() == 0
