from pyspark.sql import functions as F

from kestrel.functions import scalars
from kestrel.operators import board, security


def test_settings_over_defaults():
    defaults = {"a": {"x": 1, "y": 2}, "b": 3}
    assert board.load_settings("b = 4\n[a]\nx = 5\n", defaults) == {"a": {"x": 5, "y": 2}, "b": 4}
    assert board.load_settings("not toml [", defaults) == defaults


def test_maps(spark):
    row = spark.sql("SELECT map('a', 1, 'b', 2) AS m, map('b', 3) AS n")
    got = row.select(board.merged_maps(F.col("m"), F.col("n")).alias("m"), board.value_of(F.col("m"), "z", 9).alias("z")).first()
    assert got.m == {"a": 1, "b": 3} and got.z == 9


def test_ipv6_addresses(spark):
    rows = [("00000000000000000000000001000000:0016",), ("B80D0120000000000000000000000000:01BB",), ("0000000000000000FFFF00000100007F:0050",), ("00000000000000000000000000000000:0000",), ("0100007F:1F90",), ("xyz",)]
    got = [r.a and tuple(r.a) for r in spark.createDataFrame(rows, "v string").select(scalars.hex_address(F.col("v")).alias("a")).collect()]
    assert got == [("::1", 22), ("2001:db8::", 443), ("::ffff:7f00:1", 80), ("::", 0), ("127.0.0.1", 8080), None]


def test_git_listings(spark):
    lines = spark.createDataFrame([("r", 1, "a" * 40), ("r", 2, "b" * 40), ("r", 3, "error: x")], "project string, line_no int, line string")
    assert sorted((r.hash[0], r.depth) for r in board.ancestors(lines).collect()) == [("a", 0), ("b", 1)]
    assert [r.path for r in board.tracked(spark.createDataFrame([('"a b"',), ("c",), ("",)], "line string")).collect()] == ["a b", "c"]


def test_audits(spark):
    pip = '{"dependencies": [{"name": "a", "version": "1", "vulns": [{"id": "X-1"}, {"id": "X-2"}]}, {"name": "b", "version": "2", "vulns": []}]}'
    got = board.pip_audit(spark.createDataFrame([(1, pip), (2, "no json")], "id int, json string"), "id", "json").collect()
    assert sorted(map(tuple, got)) == [(1, "a", "1", "X-1"), (1, "a", "1", "X-2")]


def test_autostart_and_odd_files(spark):
    files = spark.createDataFrame([("a", "PATH=$PATH:/tmp/x"), ("b", "Hidden=true"), ("c", None), ("d", "[Desktop Entry]\nExec=/var/tmp/run --x")], "path string, content string")
    assert sorted((r.subject, r.rule, r.detail) for r in security.autostart(files).collect()) == [("a", "autostart.path", "/tmp/x"), ("d", "autostart.temp_exec", "/var/tmp/run")]
    meta = spark.createDataFrame([("/usr/bin/su", 0o4755, 1), ("/home/x", 0o4755, 1), ("/tmp/y", 0o755, 30), ("/tmp/z", 0o755, 3)], "path string, mode int, age_hours int")
    assert sorted((r.subject, r.rule) for r in security.odd_files(meta).collect()) == [("/home/x", "file.suid"), ("/tmp/z", "file.temp_executable")]


def test_file_metadata(spark, tmp_path):
    from kestrel.sources import files

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x").write_text("abc")
    (tmp_path / "y").write_text("")
    (tmp_path / "y").chmod(0o755)
    got = {r.path.removeprefix(f"{tmp_path}/"): (r.mode & 0o111, r.size) for r in files.read_meta(spark, str(tmp_path)).collect()}
    assert got == {"a/b/x": (0, 3), "y": (0o111, 0)}


def test_context_summary(spark):
    files = spark.createDataFrame([("a", "manage.py"), ("a", "src/x/y.py"), ("a", "src/z.tsx"), ("a", "src/z.ts"), ("b", "notes.md"), ("c", "docker-compose.yaml")], "project string, path string")
    entries = spark.createDataFrame([("a", f"e{i}.py", "starts") for i in range(7)], "project string, path string, description string")
    hubs = spark.createDataFrame([("a", "low.py", 1), ("a", "high.py", 9)], "project string, path string, importers int")
    configs = spark.createDataFrame([("c", "c.toml", None)], "project string, path string, description string")
    got = {r.project: r.context for r in board.context_summary(files, entries, hubs, configs).collect()}
    assert got["a"] == "# Project: a\n\n**Stack:** Python, Django, JavaScript/TypeScript, React\n\n**Size:** 4 files, 2 dirs\n\n**Entry points:**\n" + "\n".join(f"- `e{i}.py` — starts" for i in range(5)) + "\n\n**Key modules:**\n- `high.py` (imported by 9 files)\n- `low.py` (imported by 1 files)"
    assert got["b"] == "# Project: b\n\n**Size:** 1 files, 0 dirs" and got["c"] == "# Project: c\n\n**Stack:** Docker\n\n**Size:** 1 files, 0 dirs\n\n**Config files:**\n- `c.toml` — "
    short = {r.project: r.context for r in board.context_summary(files, entries, hubs, configs, budget=100).collect()}
    assert short["a"] == got["a"][: got["a"].index("\n\n**Entry")] and short["b"] == got["b"]
