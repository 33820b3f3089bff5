"""Queries over keys that the small tables don't reach."""

import duckdb
import pytest
from pyspark.sql import functions as F

from kestrel.functions import scalars
from kestrel.operators import board
from kestrel.plans import catalogue, derived  # noqa: F401  (registers its queries)
from kestrel.sources import logs
from test_catalogue import rows


@pytest.fixture
def parts(spark, tmp_path):
    """A folder whose part table has given keys, and DuckDB on it."""

    def make(keys: str):
        spark.sql(f"SELECT {keys} AS p_partkey").select(F.col("p_partkey").cast("long")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
        return str(tmp_path), con

    return make


def test_sockets_of_keys_beyond_four_digits(spark, parts):
    folder, con = parts("explode(array(1, 15, 65535, 65536, 70001, 120000, 7200000, 268435455))")
    got = catalogue.queries()["proc_sockets"](spark, folder).toPandas()
    assert rows(got) == rows(con.execute(catalogue.oracle_sql()["proc_sockets"]).fetchdf())


def test_addresses_that_are_none(spark):
    texts = ["0100007F:1F9", "0100007F:", "0100007F", "0100007F:1F90:1", "0100007F:123456789", "100007F:1F90"]
    found = spark.createDataFrame([(x,) for x in texts], "a string").select(scalars.hex_address(F.col("a")).alias("a"))
    assert found.where("a IS NOT NULL").count() == 0


def test_blame_of_one_path_lies_in_many_ranges(spark):
    heading = "concat(repeat('a', 40), ' 1 ', id)"
    # Line 1 has times for long, so whole ranges have no heading of their own; a second path has none at first.
    text = f"CASE WHEN id % 1000 = 0 THEN {heading} WHEN id % 2 = 0 THEN concat('author-time ', id * 86400) ELSE 'author x' END"
    lines = spark.range(20_000).selectExpr("IF(id < 15000, 'a', 'b') AS path", "id AS at", f"{text} AS line").where("at <> 15000")
    got = board.blame(lines, "path", "at")
    assert {(r.path, r.line_no) for r in got.select("path", "line_no").distinct().collect()} == {("a", i * 1000) for i in range(15)} | {("b", None)} | {("b", i * 1000) for i in range(16, 20)}
    assert got.count() == 9_980
    wrong = got.where("line_no <> floor(datediff(day, DATE'1970-01-01') / 1000) * 1000 OR (line_no IS NULL) <> (datediff(day, DATE'1970-01-01') BETWEEN 15000 AND 15999)")
    assert wrong.count() == 0
    # No window takes a path whole.
    assert "hashpartitioning(path#" in str(got._jdf.queryExecution().executedPlan()) and all("_part#" in x for x in str(got._jdf.queryExecution().executedPlan()).splitlines() if "Window" in x)


def test_session_sums_sort_what_was_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(logs, "BLOCK", 16, raising=False)
    line = """concat('{"type":"assistant","sessionId":"s', id % 2, '","timestamp":"', id, '","message":{"model":"m', id, '","usage":{"input_tokens":1}}}')"""
    rows = logs.entries(spark.range(100, 200, 1, 1).selectExpr("'/a/x.jsonl' AS file", f"{line} AS line"))
    got = logs.session_summaries(rows)
    assert sorted((r.session_id, r.model, r.turns, r.input_tokens) for r in got.collect()) == [("s0", "m100", 50, 50), ("s1", "m101", 50, 50)]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.rindex("Aggregate") < plan.index("REPARTITION_BY_NUM")
