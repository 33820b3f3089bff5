import datetime as dt
import json

from pyspark.sql import functions as F

from kestrel.functions import scalars as S
from kestrel.sources import files as trees, logs, parsed


def one(spark, schema, *values):
    return spark.createDataFrame([values], schema)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_paths(spark):
    df = spark.createDataFrame([("a/./b/../c//d.tar.GZ",), ("../x",), ("/a/..",), (".env",)], "p string")
    got = df.select(S.normal_path(F.col("p")).alias("n"), S.extension(F.col("p")).alias("e")).collect()
    assert [tuple(r) for r in got] == [("a/c/d.tar.GZ", "gz"), ("../x", ""), ("/", ""), (".env", "")]


def test_addresses_and_bits(spark):
    df = one(spark, "a string, m int", "0100007F:1F90", 0o4755)
    got = df.select(S.hex_address(F.col("a")).alias("x"), S.has_bits(F.col("m"), 0o4000).alias("s"), S.has_bits(F.col("m"), 0o002).alias("w")).first()
    assert (got.x.ip, got.x.port, got.s, got.w) == ("127.0.0.1", 8080, True, False)
    private = spark.createDataFrame([("10.0.0.1",), ("172.31.9.9",), ("172.32.0.1",), ("8.8.8.8",)], "ip string")
    assert [r[0] for r in private.select(S.is_private_ip(F.col("ip"))).collect()] == [True, True, False, False]


def test_versions(spark):
    df = spark.createDataFrame([("^1.2.3", "2.0"), ("1.2", "1.3.0"), ("1.2.3", "1.2.4"), ("2.0", "1.9"), ("x", "1")], "a string, b string")
    assert [r[0] for r in df.select(S.version_gap(F.col("a"), F.col("b"))).collect()] == ["high", "medium", "low", None, None]


def test_figures(spark):
    df = spark.createDataFrame([(999,), (3400,), (1_200_000,), (50_000,), (50_001,)], "n long")
    assert [tuple(r) for r in df.select(S.token_count(F.col("n")), S.usage_level(F.col("n"))).collect()] == [("999", 1), ("3.4K", 1), ("1.2M", 4), ("50.0K", 1), ("50.0K", 2)]


def test_generated_and_test_paths(spark):
    df = spark.createDataFrame([("src/generated/a.ts",), ("a.min.js",), ("yarn-4.1.cjs",), ("tests/x.py",), ("src/a.ts",)], "p string")
    assert [tuple(r) for r in df.select(S.is_generated(F.col("p")), S.is_test_path(F.col("p"))).collect()] == [(True, False), (True, False), (True, False), (False, True), (False, False)]


def test_tree(spark, tmp_path):
    for name, text in {"a.py": "x = 1", "lib/b.ts": "", "node_modules/c.js": "c", "own/pyvenv.cfg": "x", "own/lib/d.py": "d", "skip/e.py": "e", "f.txt": "f", ".env": "A=1\n#B=2\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = trees.read_tree(spark, str(tmp_path)).cache()
    assert {r.path for r in trees.source_files(found, ignore=["# no", "skip/"]).collect()} == {"a.py", "lib/b.ts"}
    assert rows(trees.configs(found)) == [(".env", "env", 1)]
    assert trees.has_extension(found, "txt").first().found and not trees.has_extension(found, "rs").first().found
    assert tuple(trees.file_tree(found).first()) == (8, 5, 19, 2)
    assert [tuple(r) for r in trees.features(found).collect()] == [("other", 3), ("own", 2), ("lib", 1), ("node_modules", 1), ("skip", 1)]


def test_ignore_patterns_take_back(spark):
    df = spark.createDataFrame([("a.log",), ("keep.log",), ("d/a.log",), ("docs/x.md",), ("in/docs/x.md",)], "path string")
    assert [r[0] for r in df.select(trees.ignored_by(F.col("path"), ["*.log", "!keep.log", "/docs"])).collect()] == [True, False, True, True, False]


def usage(**kw):
    return {"input_tokens": 1000, "output_tokens": 500, "cache_read_input_tokens": 8000, "cache_creation_input_tokens": 1000} | kw


def test_session_logs(spark):
    name = "file:/x/projects/-home-me-shop/s1.jsonl"
    entry = lambda **kw: json.dumps(kw)
    lines = [
        entry(type="user", sessionId="s1", timestamp="2026-04-10T10:00:00Z", message={"content": "/plan old prompt"}),
        entry(type="user", sessionId="s1", timestamp="2026-04-10T11:00:00Z", message={"content": [{"type": "text", "text": " new "}, {"type": "text", "text": "prompt"}]}),
        entry(type="user", sessionId="s1", timestamp="2026-04-10T12:00:00Z", message={"content": [{"type": "tool_result", "content": "out"}]}),
        entry(type="assistant", sessionId="s1", timestamp="2026-04-10T10:30:00Z", message={"model": "m", "content": "reply", "usage": usage()}),
        entry(type="assistant", sessionId="s1", timestamp="2026-04-10T10:40:00Z", message={"content": "x"}),
        entry(type="assistant", sessionId="s1", message="no object"),
        entry(type="system", sessionId="s1", timestamp="2026-04-10T12:00:00Z", durationMs=7),
        "{broken",
    ]
    found = logs.entries(spark.createDataFrame([(name, x) for x in lines], "file string, line string"))
    assert rows(logs.assistant_records(found)) == [("s1", "shop", "m", 1000, 500, 8000, 1000), ("s1", "shop", "unknown", 0, 0, 0, 0)]
    assert [r.text for r in logs.user_prompts(found).collect()] == ["new\nprompt", "/plan old prompt"]
    s = logs.session_summaries(found).first()
    assert (s.model, s.first, s.commands, s.duration_ms, s.turns, s.total_tokens) == ("m", "/plan old prompt", ["/plan"], 7, 3, 1500)


def test_history_day_ends_early(spark):
    at = lambda s: int(dt.datetime(2026, 4, 10, 23, 59, 59, int(s * 1e6), tzinfo=dt.UTC).timestamp() * 1000)
    lines = [json.dumps({"timestamp": t, "sessionId": i, "project": p}) for t, i, p in ((at(0), "a", "x"), (at(0.5), "b", "x"), (at(0) - 9, "a", "w"))]
    assert rows(logs.history_index(spark.createDataFrame([(x,) for x in lines], "line string"), "2026-04-10")) == [("a", "x")]


def test_manifests(spark):
    files = {
        "package.json": '{"dependencies": {"react": "^18.0.0"}, "devDependencies": {"jest": ""}}',
        "requirements.txt": "Requests>=2.28,<3; python_version > '3'\n# no\n-r other\nflask\n",
        "pyproject.toml": '[project]\ndependencies = ["numpy>=1"]\n[tool.poetry.dependencies]\npython = "^3"\nrich = {version = "1"}\n',
        "Cargo.toml": '[dependencies]\nserde = "1.0"\n',
        "go.mod": "module x\nrequire (\n\tgithub.com/a/b v1.0.0\n)\nrequire github.com/c/d v2.0.0\n",
        "x/pyproject.toml": "broken = [",
    }
    deps = parsed.dependencies(spark.createDataFrame(list(files.items()), "path string, content string"))
    assert rows(deps.select("name", "version", "ecosystem")) == sorted(
        [("react", "^18.0.0", "npm"), ("jest", None, "npm"), ("requests", ">=2.28,<3", "pypi"), ("flask", None, "pypi"), ("numpy", ">=1", "pypi"), ("rich", "1", "pypi"), ("serde", "1.0", "cargo"), ("github.com/a/b", "v1.0.0", "go"), ("github.com/c/d", "v2.0.0", "go")], key=repr
    )


def test_git_status_keeps_leading_spaces(spark):
    lines = [" M a.py", "MM b.py", "?? c.py", "R  d -> e", "UU f.py", " D g.py", "A  h.py"]
    got = rows(parsed.git_status(spark.createDataFrame([(x,) for x in lines], "line string")))
    assert got == sorted([("modified", "a.py"), ("staged", "b.py"), ("modified", "b.py"), ("untracked", "c.py"), ("renamed", "d -> e"), ("unmerged", "f.py"), ("deleted", "g.py"), ("staged", "h.py")], key=repr)


def test_commits(spark):
    lines = ["abc fix", " 2 files changed, 301 insertions(+), 5 deletions(-)", "def feat: add login", " 1 file changed, 3 deletions(-)", "fed merge it"]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "repo string, line_no int, line string")
    assert [tuple(r)[2:] for r in parsed.commits(df).orderBy("line_no").collect()] == [("abc", "fix", 306, True, True), ("def", "feat: add login", 3, False, False), ("fed", "merge it", 0, False, False)]


def test_ports_markdown_and_runs(spark):
    ss = ['LISTEN 0 128 0.0.0.0:80 0.0.0.0:* users:(("nginx",pid=7,fd=4))', "LISTEN 0 128 [::]:80 [::]:*", "State x"]
    assert rows(parsed.listening_ports(spark.createDataFrame([(x,) for x in ss], "value string"))) == [("0.0.0.0", 80, 7, "nginx", True, True), ("::", 80, 0, "", False, True)]
    md = "- [no](x) - y\n## Tools\n- [A](http://a) — first\n### uk\n- [B](http://b) - second\n## End\n- [C](c) - third"
    got = parsed.markdown_items(spark.createDataFrame([("m", md)], "path string, content string")).orderBy("line_no").collect()
    assert [(r.section, r.group, r.title, r.description) for r in got] == [("Tools", None, "A", "first"), ("Tools", "uk", "B", "second"), ("End", None, "C", "third")]
    out = [("c", "test result: ok. 3 passed; 1 failed; 2 ignored\ntest result: ok. 4 passed; 0 failed; 0 ignored"), ("p", "=== 1 failed ===\n==== 5 passed, 2 skipped in 1s ===="), ("n", "")]
    assert rows(parsed.test_counts(spark.createDataFrame(out, "run string, output string"))) == [("c", 7, 1, 2, 0), ("n", 0, 0, 0, 0), ("p", 5, 0, 2, 0)]
