"""Texts of other tools as rows: manifests, git output, listings of ports, markdown lists, test runs."""

from __future__ import annotations

import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from kestrel.functions import scalars as S

LIB = "array<struct<name: string, version: string>>"


def _lines(df: DataFrame, key: list[str], text: str = "content") -> DataFrame:
    rows = df.select(*key, F.posexplode(F.split(F.regexp_replace(text, "\r?\n$", ""), "\r?\n")).alias("pos", "line"))
    return rows.select(*key, (F.col("pos") + 1).cast("long").alias("line_no"), "line")


# ---- manifests


def requirement(spec: Column) -> Column:
    """struct(name, version) of a requirement such as `requests>=2.28,<3; marker` (X13); null if it has no name."""
    pattern = r"^([A-Za-z0-9_.\-]+)\s*(.*?)\s*(?:;|$)"
    found = F.struct(F.lower(F.regexp_extract(spec, pattern, 1)).alias("name"), F.nullif(S.stripped(F.regexp_extract(spec, pattern, 2)), F.lit("")).alias("version"))
    return F.when(spec.rlike(pattern), found)


def _toml_libs(text: Column, cargo: bool) -> Column:
    """Dependencies of pyproject.toml or Cargo.toml (E5); a text that does not parse has none."""

    def version(v):
        return v if isinstance(v, str) else v.get("version") if isinstance(v, dict) else None

    def read(t):
        try:
            data = tomllib.loads(t or "")
        except (tomllib.TOMLDecodeError, RecursionError):
            return []
        top = data if cargo else (data.get("tool") or {}).get("poetry") or {}
        own = [] if cargo else [{"name": str(d), "version": None} for d in (data.get("project") or {}).get("dependencies") or []]
        tables = [t for s in ("dependencies", "dev-dependencies") if isinstance(t := top.get(s) or {}, dict)]
        return own + [{"name": n, "version": version(v) or ""} for t in tables for n, v in t.items() if cargo or n != "python"]

    @F.pandas_udf(LIB)
    def libs(texts: pd.Series) -> pd.Series:
        return texts.map(read)

    return libs(text)


def dependencies(files: DataFrame) -> DataFrame:
    """(path, name, version, ecosystem) of all manifests (S15): npm, pypi, go and cargo.

    A version is null where none is given; requirement lists give lower-case names.
    """
    name = S.basename(F.col("path"))
    sections = [F.from_json(F.get_json_object("content", f"$.{s}"), "map<string, string>") for s in ("dependencies", "devDependencies", "peerDependencies")]
    pairs = F.concat(*(F.coalesce(F.map_entries(s), F.array().cast("array<struct<key: string, value: string>>")) for s in sections))
    npm = files.where(name == "package.json").select("path", F.explode(pairs).alias("p")).select("path", F.col("p.key").alias("name"), F.nullif("p.value", F.lit("")).alias("version"), F.lit("npm").alias("ecosystem"))
    text = _lines(files.where(name.rlike("^requirements.*[.]txt$")), ["path"]).select("path", S.stripped("line").alias("line")).where(~F.col("line").rlike("^(#|-|$)"))
    pypi = text.select("path", requirement(F.col("line")).alias("r"))
    project = files.where(name == "pyproject.toml").select("path", F.explode(_toml_libs(F.col("content"), False)).alias("l"))
    pypi = pypi.union(project.select("path", F.when(F.col("l.version").isNull(), requirement(F.col("l.name"))).otherwise(F.struct(F.col("l.name").alias("name"), F.nullif("l.version", F.lit("")).alias("version")))))
    pypi = pypi.where("r IS NOT NULL").select("path", "r.name", "r.version", F.lit("pypi"))
    cargo = files.where(name == "Cargo.toml").select("path", F.explode(_toml_libs(F.col("content"), True)).alias("l")).select("path", "l.name", F.nullif("l.version", F.lit("")), F.lit("cargo"))
    lines = _lines(files.where(name == "go.mod"), ["path"]).withColumn("line", S.stripped("line"))
    mark = F.when(F.col("line").startswith("require ("), True).when(F.col("line") == ")", False)
    inside = F.coalesce(F.last(mark, ignorenulls=True).over(Window.partitionBy("path").orderBy("line_no")), F.lit(False))
    part = F.split(F.regexp_replace("line", "^require ", ""), r"\s+")
    go = lines.withColumn("inside", inside).where((F.col("inside") | F.col("line").startswith("require ")) & ~F.col("line").startswith("require ("))
    go = go.select("path", F.get(part, F.lit(0)).alias("name"), F.get(part, F.lit(1)).alias("version"), F.lit("go")).where("name LIKE '%/%' AND version IS NOT NULL")
    return npm.union(pypi).union(cargo).union(go)


def outdated(deps: DataFrame, latest: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Dependencies with a newer version in a table (ecosystem, name, latest, checked_at) of no older than `hours`."""
    fresh = latest.where(F.col("checked_at") >= now - F.make_interval(hours=F.lit(hours)))
    rows = deps.join(fresh.select("ecosystem", "name", "latest"), ["ecosystem", "name"]).withColumn("severity", S.version_gap(F.col("version"), F.col("latest")))
    return rows.where("severity IS NOT NULL").select("path", "ecosystem", "name", "version", "latest", "severity")


def unused_requirements(deps: DataFrame, imported: DataFrame, standard: list[str]) -> DataFrame:
    """(missing) top-level modules that are imported and neither required nor of the standard library."""
    known = deps.select(F.regexp_replace(F.lower("name"), "-", "_").alias("known")).distinct()
    return imported.select(F.substring_index("module", ".", 1).alias("missing")).distinct().where(~F.col("missing").isin(standard) & (F.col("missing") != "")).join(known, F.lower("missing") == F.col("known"), "left_anti")


# ---- git


def git_status(lines: DataFrame, line: str = "line") -> DataFrame:
    """(bucket, path) of porcelain lines, unstripped (A22, X15, Q31); one path may stand in two buckets."""
    x, y, path = F.substring(line, 1, 1), F.substring(line, 2, 1), F.expr(f"substring({line}, 4)")
    is_in = lambda c, letters: c.isin(list(letters))
    whole = F.when((x == "?") & (y == "?"), "untracked").when((x == "U") | (y == "U"), "unmerged")
    staged = F.when(x == "R", "renamed").when(is_in(x, "AMDCT"), "staged")
    tree = F.when(is_in(y, "MT"), "modified").when((x == " ") & (y == "D"), "deleted").when((x == " ") & (y == "R"), "renamed")
    buckets = F.when(whole.isNotNull(), F.array(whole)).otherwise(F.array_compact(F.array(staged, tree)))
    return lines.where(F.length(line) >= 3).select(F.explode(buckets).alias("bucket"), path.alias("path"))


def git_changes(name_status: DataFrame, numstat: DataFrame, line: str = "line") -> DataFrame:
    """(path, status, added, removed) from the two diff listings (J20); binary files count 0; a rename is its new path."""
    part = F.split(line, "\t")
    status = name_status.select(F.substring(F.get(part, F.lit(0)), 1, 1).alias("status"), F.element_at(part, -1).alias("path")).where(F.size(part) >= 2)
    number = lambda i: F.coalesce(F.get(part, F.lit(i)).try_cast("bigint"), F.lit(0))
    path = F.regexp_replace(F.get(part, F.lit(2)), r"\{?([^{}]*) => ([^{}]*)\}?", "$2")
    counts = numstat.where(F.size(part) >= 3).select(path.alias("path"), number(0).alias("added"), number(1).alias("removed")).dropDuplicates(["path"])
    return status.join(counts, "path", "left").na.fill(0, ["added", "removed"]).select("path", "status", "added", "removed")


#: Messages that say nothing.
VAGUE = ["fix", "update", "wip", "test", "asdf", ".", "temp", "stuff", "changes"]


def commits(lines: DataFrame, repo: str = "repo", order: str = "line_no", line: str = "line") -> DataFrame:
    """(repo, line_no, hash, message, changed, vague, big) of a one-line log with short stats."""
    after = F.lead(line).over(Window.partitionBy(repo).orderBy(order))
    number = lambda word: F.coalesce(F.regexp_extract("_after", rf"(\d+) {word}", 1).try_cast("bigint"), F.lit(0))
    rows = lines.where(S.stripped(line) != "").withColumn("_after", S.stripped(after)).where(~F.col(line).rlike(r"^\s*\d+ files? changed") & S.stripped(line).contains(" "))
    changed = F.when(F.col("_after").rlike(r"^\d+ files? changed"), number("insertion") + number("deletion")).otherwise(0)
    message = S.stripped(F.regexp_extract(S.stripped(line), r"^\S+\s(.*)$", 1))
    vague = F.lower(message).isin(VAGUE) | (F.length(message) < 4)
    return rows.select(repo, order, F.substring_index(S.stripped(line), " ", 1).alias("hash"), message.alias("message"), changed.alias("changed"), vague.alias("vague"), (changed > 300).alias("big"))


def scope_creep(changes: DataFrame, since: Column, most: int = 5) -> DataFrame:
    """(repo, commits, created, deleted, creeping) of (repo, hash, ts, status) rows since a time."""
    counts = changes.where(F.col("ts") >= since).groupBy("repo").agg(F.count_distinct("hash").alias("commits"), F.count_if(F.col("status") == "A").alias("created"), F.count_if(F.col("status") == "D").alias("deleted"))
    return counts.withColumn("creeping", (F.col("created") > most) & (F.col("deleted") == 0))


# ---- listings, lists and runs


def listening_ports(lines: DataFrame, line: str = "value") -> DataFrame:
    """(ip, port, pid, process, exposed, conflict) of `ss -tlnp` lines (S12, A24); a port that stands twice conflicts."""
    part = F.split(S.stripped(line), r"\s+")
    local, info = F.get(part, F.lit(3)), F.element_at(part, -1)
    port = F.regexp_extract(local, r":(\d+)$", 1).try_cast("int")
    ip = F.regexp_replace(F.regexp_replace(local, r":[^:]*$", ""), r"[\[\]]", "")
    pid = F.coalesce(F.regexp_extract(info, r"pid=(\d+)", 1).try_cast("int"), F.lit(0))
    ip = F.when(ip == "", "0.0.0.0").otherwise(ip)
    rows = lines.where(F.size(part) >= 5).select(ip.alias("ip"), port.alias("port"), pid.alias("pid"), F.regexp_extract(info, r'\(\("([^"]*)"', 1).alias("process")).where("port IS NOT NULL")
    counts = rows.groupBy("port").agg((F.count("*") > 1).alias("conflict"))
    return rows.withColumn("exposed", F.col("ip") == "0.0.0.0").join(counts, "port").select("ip", "port", "pid", "process", "exposed", "conflict")


def markdown_items(docs: DataFrame, key: str = "path") -> DataFrame:
    """(key, line_no, section, group, title, url, description) of `- [title](url) - text` items below `## ` and `### ` headings."""
    lines = _lines(docs, [key]).withColumn("line", S.stripped("line"))
    section = F.when(F.col("line").startswith("## "), S.stripped(F.expr("substring(line, 4)")))
    group = F.when(F.col("line").startswith("### "), S.stripped(F.expr("substring(line, 5)"))).when(section.isNotNull(), "")
    w = Window.partitionBy(key).orderBy("line_no")
    rows = lines.withColumn("section", F.last(section, ignorenulls=True).over(w)).withColumn("group", F.nullif(F.last(group, ignorenulls=True).over(w), F.lit("")))
    pattern = r"^-\s+\[(.+?)\]\((.+?)\)\s*[—–\-]\s*(.*)$"
    part = lambda i: S.stripped(F.regexp_extract("line", pattern, i))
    return rows.where(F.col("section").isNotNull() & F.col("line").rlike(pattern)).select(key, "line_no", "section", "group", part(1).alias("title"), part(2).alias("url"), part(3).alias("description"))


def test_counts(runs: DataFrame, key: str = "run", text: str = "output") -> DataFrame:
    """(key, passed, failed, skipped, errors) of test output (A30): sums of `test result:` lines, else the last `=== ... ===` summary."""
    cargo = r"test result:\s+\S+\.\s+(\d+)\s+passed;\s+(\d+)\s+failed;\s+(\d+)\s+ignored"
    total = lambda i: F.aggregate(F.regexp_extract_all(text, F.lit(cargo), F.lit(i)), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    summaries = F.filter(F.regexp_extract_all(text, F.lit(r"(?m)^=+\s*(.*?)\s*=+$"), F.lit(1)), lambda s: s.rlike("passed|failed|skipped|error"))
    last = F.coalesce(F.try_element_at(summaries, F.lit(-1)), F.lit(""))
    number = lambda word: F.coalesce(F.regexp_extract(last, rf"(\d+)\s+{word}\b", 1).try_cast("bigint"), F.lit(0))
    is_cargo = F.col(text).rlike(cargo)
    pick = lambda i, word: F.when(is_cargo, total(i)).otherwise(number(word))
    return runs.select(key, pick(1, "passed").alias("passed"), pick(2, "failed").alias("failed"), pick(3, "skipped").alias("skipped"), F.when(is_cargo, 0).otherwise(number("errors?")).alias("errors"))


def tail(lines: DataFrame, key: str, order: str, n: int = 200) -> DataFrame:
    """The last n lines of each stream (S28): a report of bounded length."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return lines.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")
