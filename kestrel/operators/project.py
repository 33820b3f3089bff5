"""Findings on whole projects: readme, ignore files, tests, styles, missing types and what a file is for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kestrel.functions import scalars as S
from kestrel.sources.files import glob_regex

#: Words that show that a readme tells how to install and run.
INSTALL_WORDS = ["install", "setup", "getting started"]
RUN_WORDS = ["run", "start", "usage"]
#: Names of test files.
TEST_NAMES = [
    "test_*.py", "*_test.py", "*.test.js", "*.spec.js", "*.test.ts", "*.spec.ts", "*.test.jsx", "*.spec.jsx", "*.test.tsx", "*.spec.tsx", "*_test.go", "*_spec.rb",
    "*_test.rb", "*Test.java", "*Tests.java", "*Test.kt", "*Tests.kt", "*Test.php", "*_test.exs", "*Tests.cs", "*Test.cs",
]
#: Parts of paths whose files are no tests of the project.
FOREIGN = ["node_modules", ".venv", "venv", "__pycache__", "fixtures"]
#: Style rules as (pattern, rule); the first group are clichés, the second are faults.
STYLE_SLOP = [
    (r"#[89a-f][0-9a-f]00[89a-f][89a-f]|purple|#800080|#9b59b6|#6c5ce7|#a855f7", "purple-gradient"),
    (r"font-family:.*\bInter\b", "inter-font"),
    (r"font-family:.*\bRoboto\b", "roboto-font"),
    (r"border-radius:\s*(16|20|24|28|32)\s*px", "huge-radius"),
    (r"box-shadow:.*0\s+0\s+\d+px\s+\d+px.*rgba\(", "glow-shadow"),
    (r"backdrop-filter:\s*blur", "backdrop-blur"),
    (r"linear-gradient.*(?:#[89a-f]|purple|violet|indigo)", "purple-gradient-bg"),
]
STYLE_QUALITY = [
    (r"padding:\s*[0-3]px", "cramped-padding"),
    (r"font-size:\s*[0-9]px\b", "tiny-font"),
    (r"font-size:\s*(8|9)px", "tiny-font-critical"),
    (r"color:\s*#[0-9a-f]{3,6}.*background:\s*#[0-9a-f]{3,6}|background:\s*#[0-9a-f]{3,6}.*color:\s*#[0-9a-f]{3,6}", "contrast-check"),
    (r"!important", "important-abuse"),
    (r"margin:\s*-\d+px", "negative-margin"),
]


def _has_any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(w.replace(".", "[.]") for w in words))


def readmes(files: DataFrame) -> DataFrame:
    """(project, severity, missing) of each project's top-level readme (D32); medium and `readme` without one."""
    text = F.lower("content")
    name = F.lower("path")
    words = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))
    gaps = F.array_compact(F.array(F.when(~_has_any(text, INSTALL_WORDS), "install"), F.when(~_has_any(text, RUN_WORDS), "run"), F.when(words < 20, "description")))
    found = files.where(name.rlike(r"^readme([.](md|mdx|rst|txt|adoc))?$")).groupBy("project").agg(F.min_by(gaps, F.col("path")).alias("missing"))
    rows = files.select("project").distinct().join(found, "project", "left")
    severity = F.when(F.col("missing").isNull(), "medium").when(F.size("missing") > 0, "low").otherwise("info")
    return rows.select("project", severity.alias("severity"), F.coalesce("missing", F.array(F.lit("readme"))).alias("missing"))


def ignore_gaps(files: DataFrame) -> DataFrame:
    """(project, severity, missing) of patterns that ignore files at the top or one folder down should hold."""
    path = F.col("path")
    lists = files.where(path.rlike(r"^([^/]+/)?[.]gitignore$"))
    holds = lambda p: F.bool_or(F.col("content").contains(p))
    patterns = {"__pycache__": "python", ".venv": "python", "*.pyc": "python", "node_modules": "node", ".next": "next", ".env": "env", ".DS_Store": "all"}
    held = lists.groupBy("project").agg(*(holds(p).alias(f"h{i}") for i, p in enumerate(patterns)))
    kinds = files.groupBy("project").agg(
        F.bool_or((S.extension(path) == "py") & (S.depth(path) <= 3)).alias("python"), F.bool_or(path == "package.json").alias("node"), F.bool_or(path.startswith(".next/")).alias("next"), F.bool_or(path.rlike("^[.]env[^/]*$")).alias("env"), F.lit(True).alias("all")
    )
    rows = kinds.join(held.withColumn("any", F.lit(True)), "project", "left")
    gaps = F.array_compact(F.array(*(F.when(F.col(kind) & (F.col("node") if kind == "next" else F.lit(True)) & ~F.col(f"h{i}"), p) for i, (p, kind) in enumerate(patterns.items()))))
    missing = F.when(F.col("any").isNull(), F.array(F.lit(".gitignore"))).otherwise(gaps)
    severity = F.when(F.col("any").isNull() | F.array_contains(missing, ".env"), "medium").otherwise("low")
    return rows.select("project", severity.alias("severity"), missing.alias("missing")).where(F.size("missing") > 0)


def tests(files: DataFrame) -> DataFrame:
    """(project, tests, framework, severity) (D23): high without a test file."""
    path = F.col("path")
    name = S.basename(path)
    test = name.rlike("|".join(glob_regex(p) for p in TEST_NAMES)) & ~_has_any(path, FOREIGN)
    has = lambda pattern: F.bool_or(path.rlike(pattern))
    rows = files.groupBy("project").agg(
        F.count_if(test).alias("named"), F.count_if(path.rlike("^tests/.*[.]rs$") & ~path.contains("target")).alias("rust"), has("^((tests|test)/)?conftest[.]py$|^pytest[.]ini$|^pyproject[.]toml$").alias("pytest"),
        has("^jest[.]config[.](js|ts)$").alias("jest"), (has("^go[.]mod$") & F.bool_or(test & path.endswith("_test.go"))).alias("go"), has("^Cargo[.]toml$").alias("cargo"),
    )
    n = F.col("named") + F.when(F.col("cargo"), F.col("rust")).otherwise(0)
    framework = F.when(F.col("pytest"), "pytest").when(F.col("jest"), "jest").when(F.col("go"), "go test").when(F.col("cargo"), "cargo test").otherwise("unknown")
    return rows.select("project", n.alias("tests"), framework.alias("framework"), F.when(n == 0, "high").otherwise("info").alias("severity"))


def styles(files: DataFrame) -> DataFrame:
    """(project, path, line, check_id, rule) of style texts in Python files, a rule once a line."""
    seen = files.where(F.col("path").endswith(".py") & ~F.col("path").rlike("(^|/)([.]venv|venv|node_modules|__pycache__|[.]git|[.]tox)/"))
    ends = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    parts = seen.select("project", "path", F.split("content", r"(?=setStyleSheet\s*\()").alias("parts")).select("project", "path", "parts", F.posexplode("parts").alias("k", "part"))
    line = F.aggregate(F.slice("parts", F.lit(1), F.col("k")), F.lit(1), lambda n, t: n + ends(t))
    call = F.coalesce(F.nullif(F.regexp_extract("part", r"""^setStyleSheet\s*\(\s*f?"([^"]*)\"""", 1), F.lit("")), F.regexp_extract("part", r"""^setStyleSheet\s*\(\s*f?'([^']*)'""", 1))
    calls = parts.select("project", "path", line.cast("long").alias("line"), call.alias("css"))
    lines = seen.select("project", "path", F.posexplode(F.split("content", "\r?\n")).alias("k", "text")).where(F.col("text").rlike("background:|color:|border:|font-|padding:|margin:|border-radius:"))
    strings = lines.select("project", "path", (F.col("k") + 1).cast("long").alias("line"), F.explode(F.regexp_extract_all("text", F.lit('f?"([^"]{10,})"'), F.lit(1))).alias("css")).where(F.col("css").rlike("background|color|border|font|padding"))
    hit = lambda check, rules: [F.when(F.col("css").rlike(f"(?i){p}"), F.struct(F.lit(f"uiux.{check}").alias("check_id"), F.lit(r).alias("rule"))) for p, r in rules]
    rules = F.array_compact(F.array(*hit("qss_slop", STYLE_SLOP), *hit("qss_quality", STYLE_QUALITY)))
    return calls.union(strings).where("trim(css) != ''").select("project", "path", "line", F.inline(rules)).distinct()


def missing_types(facts: DataFrame) -> DataFrame:
    """(project, path, line, name, untyped, no_return) of Python functions without full types, outside tests."""
    rows = facts.where("kind = 'untyped'").where(~S.is_test_path(F.col("path")))
    return rows.select("project", "path", "line", "name", F.col("n").alias("untyped"), F.col("flag").alias("no_return"))


def unfinished(status: DataFrame, most: int = 5) -> DataFrame:
    """(repo, dirty, severity) of (repo, bucket, path) rows: paths count once."""
    return status.groupBy("repo").agg(F.count_distinct("path").alias("dirty")).withColumn("severity", F.when(F.col("dirty") > most, "medium").otherwise("info"))
