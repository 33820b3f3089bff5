"""Small aggregates, look-ups and texts behind overview boards and tool views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from kestrel.functions import scalars as S
from kestrel.operators import shared

#: Names of files and folders that are no work of their own.
JUNK = ["__pycache__", ".pyc", ".pyo", ".DS_Store", "Thumbs.db", ".idea", ".vscode", "node_modules", ".pytest_cache", ".mypy_cache", ".ruff_cache", "dist", "build", ".egg-info"]
#: What a file is for, by patterns on its path in either case, the first that matches.
PURPOSES = [
    (r"(^|/)docker-compose[^/]*\.ya?ml$", "Docker config — which services run"),
    (r"(^|/)Dockerfile(\.[^/]*)?$", "Docker image — how container is built"),
    (r"(^|/)\.dockerignore$", "Docker ignore — files excluded from build"),
    (r"\.github/workflows/.*\.ya?ml$", "GitHub Actions CI/CD pipeline"),
    (r"\.gitlab-ci\.ya?ml$", "GitLab CI/CD pipeline"),
    (r"(^|/)Jenkinsfile$", "Jenkins CI/CD pipeline"),
    (r"(^|/)requirements.*\.txt$", "Python dependencies — what gets installed"),
    (r"(^|/)pyproject\.toml$", "Python project config — dependencies & tools"),
    (r"(^|/)setup\.(py|cfg)$", "Python package config"),
    (r"(^|/)Pipfile(\.lock)?$", "Python dependencies (Pipenv)"),
    (r"(^|/)poetry\.lock$", "Python dependency lock — exact versions pinned"),
    (r"/migrations/.*\.py$", "DB migration — changes database structure"),
    (r"alembic/versions/.*\.py$", "DB migration (Alembic) — changes database structure"),
    (r"(^|/)package\.json$", "Node.js/JS project config — dependencies & scripts"),
    (r"(^|/)package-lock\.json$", "JS dependency lock — exact versions pinned"),
    (r"(^|/)yarn\.lock$", "JS dependency lock (Yarn) — exact versions pinned"),
    (r"(^|/)pnpm-lock\.yaml$", "JS dependency lock (pnpm) — exact versions pinned"),
    (r"(^|/)tsconfig.*\.json$", "TypeScript config"),
    (r"(^|/)webpack\.config\.", "Webpack bundler config"),
    (r"(^|/)vite\.config\.", "Vite bundler config"),
    (r"(^|/)\.env\.example$", "Env template — example config (no real secrets)"),
    (r"(^|/)\.env(\.[^/]*)?$", "Environment variables — secrets, keys, settings"),
    (r"(^|/)\.gitignore$", "Git ignore — files excluded from version control"),
    (r"(^|/)\.gitattributes$", "Git attributes — line endings, diff settings"),
    (r"(^|/)Makefile$", "Makefile — build/automation commands"),
    (r"(^|/)Procfile$", "Procfile — how app runs in production"),
    (r"(^|/)nginx.*\.conf$", "Nginx web server config"),
    (r"(^|/)\.eslintrc", "ESLint config — JS code style rules"),
    (r"(^|/)\.prettierrc", "Prettier config — code formatting rules"),
    (r"(^|/)CLAUDE\.md$", "Claude Code instructions — AI assistant config"),
    (r"\.tf$", "Terraform — infrastructure as code"),
    (r"(^|/)terraform\.tfvars", "Terraform variables"),
    (r"(^|/)k8s/.*\.ya?ml$", "Kubernetes config"),
    (r"(^|/)helm/.*\.ya?ml$", "Helm chart — Kubernetes package config"),
]
#: What a file is for by its extension, where no pattern matches, and else.
PURPOSES_BY_EXTENSION = {
    "py": "Python source code", "js": "JavaScript source code", "ts": "TypeScript source code", "jsx": "React component (JSX)", "tsx": "React component (TypeScript)",
    "vue": "Vue.js component", "svelte": "Svelte component", "html": "HTML page", "css": "Stylesheet", "scss": "SASS stylesheet", "sql": "SQL query/script",
    "sh": "Shell script", "bash": "Bash script", "ps1": "PowerShell script", "bat": "Windows batch script", "cmd": "Windows command script",
    "md": "Documentation (Markdown)", "rst": "Documentation (reStructuredText)", "json": "JSON data/config", "yaml": "YAML config", "yml": "YAML config",
    "toml": "TOML config", "ini": "INI config", "cfg": "Config file", "xml": "XML data/config", "go": "Go source code", "rs": "Rust source code",
    "java": "Java source code", "kt": "Kotlin source code", "rb": "Ruby source code", "php": "PHP source code", "c": "C source code", "cpp": "C++ source code",
    "h": "C/C++ header file", "cs": "C# source code", "swift": "Swift source code", "r": "R script", "dart": "Dart source code", "lua": "Lua script",
    "ex": "Elixir source code", "erl": "Erlang source code",
}
OTHER_PURPOSE = "Project file"


def counts(rows: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Rows by key."""
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def lookup(rows: DataFrame, **keys) -> DataFrame:
    """The row of a key, if there is one (F17); the keys reach the scan."""
    return rows.where(reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(v)) for k, v in keys.items()))).limit(1)


def labelled(rows: DataFrame, labels: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Rows with the label of their key, '' without one (J1); a key has one label."""
    return rows.join(labels.select(key, label), key, "left").withColumn(label, F.coalesce(label, F.lit("")))


def value_of(mapping: Column, key: str, default) -> Column:
    """A map's value or a default."""
    return F.coalesce(F.try_element_at(mapping, F.lit(key)), F.lit(default))


def merged_maps(base: Column, over: Column) -> Column:
    """Entries of both, those of the second where both have a key."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(over), k)), over)


def deep_merge(defaults: dict, over: dict) -> dict:
    """Settings over their defaults, table by table."""
    both = lambda k: deep_merge(defaults[k], over[k]) if isinstance(defaults.get(k), dict) and isinstance(over[k], dict) else over[k]
    return defaults | {k: both(k) for k in over}


def load_settings(text: str, defaults: dict) -> dict:
    """TOML settings over their defaults; a text that does not parse gives the defaults."""
    import tomllib

    try:
        return deep_merge(defaults, tomllib.loads(text))
    except tomllib.TOMLDecodeError:
        return defaults


def json_value(text: Column, path: str, default: str) -> Column:
    """The value at a path of names in a JSON text, or a default."""
    return F.coalesce(F.get_json_object(text, f"$.{path}"), F.lit(default))


def message(template: str, *names: str) -> Column:
    """A text with {name} places filled from columns."""
    out = F.lit(template)
    for name in names:
        out = F.replace(out, F.lit(f"{{{name}}}"), F.col(name).cast("string"))
    return out


def without_junk(files: DataFrame) -> DataFrame:
    """Files that are work: none of the junk names is a part of the path or its ending."""
    names = "|".join(n.replace(".", r"\.") for n in JUNK if not n.startswith(".py") and n != ".egg-info")
    return files.where(~F.col("path").rlike(rf"(^|/)({names})(/|$)|\.py[co]$|\.egg-info(/|$)"))


def explanation(path: Column) -> Column:
    """What a file is for: the first pattern that its path matches, else by extension, else a fixed text (P4).  Either slash parts a path."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    extension = F.lower(F.regexp_extract(path, r"[^/.][^/]*[.]([^/.]+)/*$", 1))  # a name that only begins with a dot has none
    by_extension = F.element_at(F.create_map(*(F.lit(x) for pair in PURPOSES_BY_EXTENSION.items() for x in pair)), extension)
    return F.coalesce(*(F.when(path.rlike(f"(?i){p}"), F.lit(what)) for p, what in PURPOSES), by_extension, F.lit(OTHER_PURPOSE))


def context_summary(files: DataFrame, entries: DataFrame, hubs: DataFrame, configs: DataFrame, by: str = "project", shown: int = 5, budget: int | None = None) -> DataFrame:
    """(by, context): a project in a few lines, for a language model.

    files (by, path) give stack and size; entries and configs (by, path, description) and hubs (by, path,
    importers) the first `shown` lines of a section each, in order of their paths, hubs by importers.
    With a budget of characters sections go in from the first until the next does not fit; the heading
    always stays.  Sections without rows are left out, and so are projects without files.
    """
    path = F.col("path")
    ends = lambda *found: F.max(F.lower(path).rlike(rf"[.]({'|'.join(found)})$"))
    root = lambda *names: F.max(path.isin(*names))
    folders = F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda i: F.array_join(F.slice(F.split(path, "/"), F.lit(1), i - 1), "/")), lambda d: d != "")
    seen = files.groupBy(by).agg(
        F.count_distinct("path").alias("n"), ends("py").alias("py"), root("manage.py").alias("django"), ends("js", "ts").alias("js"), ends("jsx", "tsx").alias("react"),
        ends("vue").alias("vue"), root("docker-compose.yml", "docker-compose.yaml").alias("docker"),
    )
    dirs = files.select(by, F.explode(folders).alias("dir")).distinct().groupBy(by).agg(F.count("*").alias("dirs"))
    names = [("py", "Python"), ("py and django", "Django"), ("js", "JavaScript/TypeScript"), ("js and react", "React"), ("js and vue", "Vue"), ("docker", "Docker")]
    stack = F.array_join(F.array_compact(F.array(*(F.when(F.expr(test), name) for test, name in names))), ", ")

    def section(rows: DataFrame, title: str, line: Column, order: list[Column], name: str) -> DataFrame:
        ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= shown)
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))), lambda x: x["line"]), "\n")
        return ranked.groupBy(by).agg(F.concat(F.lit(f"\n\n**{title}:**\n"), listed).alias(name))

    described = F.concat(F.lit("- `"), path, F.lit("` — "), F.coalesce("description", F.lit("")))
    imported = F.concat(F.lit("- `"), path, F.lit("` (imported by "), F.col("importers").cast("string"), F.lit(" files)"))
    sections = {
        "entries": section(entries, "Entry points", described, [path, F.col("description")], "entries"),
        "hubs": section(hubs, "Key modules", imported, [F.desc("importers"), path], "hubs"),
        "configs": section(configs, "Config files", described, [path, F.col("description")], "configs"),
    }
    out = seen.join(dirs, by, "left")
    for found in sections.values():
        out = out.join(found, by, "left")
    head = F.concat(F.lit("# Project: "), F.col(by).cast("string"))
    made = F.when(stack != "", F.concat(F.lit("\n\n**Stack:** "), stack))
    size = F.concat(F.lit("\n\n**Size:** "), F.col("n").cast("string"), F.lit(" files, "), F.coalesce("dirs", F.lit(0)).cast("string"), F.lit(" dirs"))
    parts = F.array_compact(F.array(made, size, *sections))
    if budget is not None:
        room = F.aggregate(parts, F.struct(head.alias("text"), F.lit(True).alias("open")), lambda held, part: F.struct(
            F.when(held["open"] & (F.length(held["text"]) + F.length(part) <= budget), F.concat(held["text"], part)).otherwise(held["text"]).alias("text"),
            (held["open"] & (F.length(held["text"]) + F.length(part) <= budget)).alias("open"),
        ))
        return out.select(by, room["text"].alias("context"))
    return out.select(by, F.concat(head, F.array_join(parts, "")).alias("context"))


def traffic(containers: DataFrame, networks: str = "networks") -> DataFrame:
    """(name, received, sent) bytes over all interfaces of a container."""
    each = F.map_values(F.from_json(networks, "map<string, struct<rx_bytes: long, tx_bytes: long>>"))
    total = lambda field: F.aggregate(F.coalesce(each, F.array().cast("array<struct<rx_bytes: long, tx_bytes: long>>")), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[field], F.lit(0)))
    return containers.select("name", total("rx_bytes").alias("received"), total("tx_bytes").alias("sent"))


def container_counts(containers: DataFrame) -> DataFrame:
    """One row: containers, running, exited and unhealthy running ones."""
    running = F.col("status") == "running"
    return containers.agg(F.count("*").alias("containers"), F.count_if(running).alias("running"), F.count_if(F.col("status") == "exited").alias("exited"), F.count_if(running & (F.col("health") == "unhealthy")).alias("unhealthy"))


def week_sums(daily: DataFrame, day: str, columns: list[str]) -> DataFrame:
    """Sums by week, from Monday on, and the rows in it."""
    return daily.groupBy(F.to_date(F.date_trunc("week", day)).alias("week")).agg(*(F.sum(c).alias(c) for c in columns), F.count("*").alias("days"))


def line_totals(files: DataFrame) -> DataFrame:
    """(project, files, lines) of tracked files."""
    return files.groupBy("project").agg(F.count("*").alias("files"), F.sum(F.size(F.split("content", "\r?\n")).cast("long")).alias("lines"))


def style_results(results: DataFrame, json: str) -> DataFrame:
    """(source, errors, warnings) of a style checker's JSON."""
    parsed = F.explode(F.from_json(json, "array<struct<source: string, warnings: array<struct<severity: string>>>>"))
    found = results.select(parsed.alias("r")).select("r.source", F.explode_outer("r.warnings.severity").alias("severity"))
    return found.groupBy("source").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def npm_audit(results: DataFrame, key: str, json: str) -> DataFrame:
    """(key, package, severity) of an audit's JSON."""
    entries = F.explode(F.from_json(F.get_json_object(json, "$.vulnerabilities"), "map<string, struct<severity: string>>")).alias("package", "v")
    return results.select(key, entries).select(key, "package", F.col("v.severity").alias("severity"))


def pip_audit(results: DataFrame, key: str, json: str) -> DataFrame:
    """(key, package, version, advisory) of an audit's JSON."""
    kind = "array<struct<name: string, version: string, vulns: array<struct<id: string>>>>"
    found = results.select(key, F.explode(F.from_json(F.get_json_object(json, "$.dependencies"), kind)).alias("d"))
    return found.select(key, F.col("d.name").alias("package"), F.col("d.version").alias("version"), F.explode("d.vulns.id").alias("advisory"))


def with_queries(findings: DataFrame, queries: dict[str, str], rule: str = "rule") -> DataFrame:
    """Findings with what to look up about their rule, null for other rules."""
    table = F.create_map(*(F.lit(x) for pair in queries.items() for x in pair))
    return findings.withColumn("query", F.element_at(table, F.col(rule)))


def security_alerts(findings: DataFrame, by: str) -> DataFrame:
    """(by, critical, high) open findings of these severities, where there are any."""
    found = findings.where(~F.col("resolved")).groupBy(by).agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    return found.where("critical + high > 0")


def test_alerts(runs: DataFrame) -> DataFrame:
    """(project, run, alert) of projects whose last run failed or timed out."""
    last = runs.groupBy("project").agg(F.max_by(F.struct(*runs.columns), "run").alias("r")).select("r.*")
    alert = F.when(F.col("timed_out"), "timeout").when((F.col("failed") > 0) | (F.col("errors") > 0), "failed")
    return last.select("project", "run", alert.alias("alert")).where("alert IS NOT NULL")


def version_changes(seen: DataFrame, tool: str, version: str, order: str, dismissed: DataFrame) -> DataFrame:
    """Rows whose version differs from the one before it of the tool, without dismissed (tool, version) pairs."""
    before = F.lag(version).over(Window.partitionBy(tool).orderBy(order))
    changed = seen.withColumn("previous", before).where(F.col("previous") != F.col(version))
    return changed.join(dismissed.select(tool, version).distinct(), [tool, version], "left_anti")


def blame(lines: DataFrame, path: str, order: str, line: str = "line") -> DataFrame:
    """(path, line_no, day) of porcelain blame lines in order (S10, D14): a heading names the line, its author's time follows.

    Lines are dealt in ranges of path and order, so those of one path may lie in many.  A range takes the
    last heading before it from the ranges before, a row to each range that a path goes on into.
    """
    spark = lines.sparkSession
    number = F.regexp_extract(line, r"^[0-9a-f]{40} \d+ (\d+)", 1).try_cast("long")
    seconds = F.regexp_extract(line, r"^author-time (\d+)$", 1).try_cast("long")
    rows = lines.select(path, F.col(order).alias("_at"), number.alias("line_no"), seconds.alias("_seconds")).where("line_no IS NOT NULL OR _seconds IS NOT NULL")
    folder = shared.folder(spark, "blame")
    rows = shared.stash(rows, f"{folder}/rows")  # the ranges are found in one pass and dealt in another
    ranged = rows.repartitionByRange(shared.partitions(spark), path, "_at").withColumn("_part", F.spark_partition_id())
    ranged = shared.stash(ranged, f"{folder}/ranges")
    last = F.max_by("line_no", F.when(F.col("line_no").isNotNull(), F.struct("_at")))
    earlier = Window.partitionBy(path).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    entry = ranged.groupBy(path, "_part").agg(last.alias("_last")).withColumn("_entry", F.last("_last", ignorenulls=True).over(earlier))
    entry = entry.where("_entry IS NOT NULL").select(F.col(path).alias("_path"), F.col("_part").alias("_of"), "_entry")
    own = F.last("line_no", ignorenulls=True).over(Window.partitionBy(path, "_part").orderBy("_at"))
    found = ranged.withColumn("line_no", own).where("_seconds IS NOT NULL")
    found = found.join(F.broadcast(entry), (F.col("_part") == F.col("_of")) & F.col(path).eqNullSafe(F.col("_path")), "left")
    return found.select(path, F.coalesce("line_no", "_entry").alias("line_no"), F.to_date(F.timestamp_seconds("_seconds")).alias("day"))


def tracked(lines: DataFrame, line: str = "line") -> DataFrame:
    """(path) of `git ls-files` lines; quoted names lose their quotes."""
    return lines.where(F.col(line) != "").select(F.regexp_replace(line, '^"|"$', "").alias("path"))


def ancestors(lines: DataFrame, project: str = "project", order: str = "line_no", line: str = "line") -> DataFrame:
    """(project, hash, depth) of first-parent `git rev-list` lines, the head at 0."""
    depth = F.row_number().over(Window.partitionBy(project).orderBy(order)) - 1
    return lines.where(F.col(line).rlike("^[0-9a-f]{7,64}$")).select(project, F.col(line).alias("hash"), depth.alias("depth"))
