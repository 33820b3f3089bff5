"""Texts of a host's tools as tables, and findings on its settings.  Adapters hand over the texts; nothing here runs a tool or a network call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kestrel.functions import scalars as S
from kestrel.operators import state

#: Folders of scheduled scripts, in which every line counts as a command.
CRON_FOLDERS = ["/etc/cron.d", "/etc/cron.daily", "/etc/cron.hourly", "/etc/cron.weekly", "/etc/cron.monthly"]
#: Indicators of a service's status page.
INDICATORS = ["none", "minor", "major", "critical", "maintenance"]
#: Files that show a frontend project.
FRONTEND_EXTENSIONS = ["jsx", "tsx", "vue", "svelte"]
FRONTEND_FILES = ["next.config.js", "next.config.mjs", "vite.config.js", "vite.config.ts"]
#: Folders of generated modules whose cycles don't count.
GENERATED_MODULES = ["/generated/", "/__generated__/", "/generated-metadata/", "/mock-data/", "/mocks/", "/__mocks__/"]
ATTRIBUTES = (
    "struct<Created: string, RestartCount: long, State: struct<Status: string, ExitCode: long, Health: struct<Status: string>>, "
    "HostConfig: struct<Privileged: boolean, Binds: array<string>, NetworkMode: string>, Config: struct<User: string, Image: string>>"
)


def _lines(files: DataFrame, text: str = "content") -> DataFrame:
    return files.select("path", F.explode(F.split(F.coalesce(text, F.lit("")), "\r?\n")).alias("line")).select("path", S.stripped("line").alias("line")).where("line != '' AND NOT startswith(line, '#')")


def containers(rows: DataFrame, name: str = "name", json: str = "json") -> DataFrame:
    """(name, status, image, health, exit_code, restart_count, privileged, binds, network_mode, user) of containers' JSON attributes (S11); what is missing has its default."""
    a = F.from_json(json, ATTRIBUTES)
    of = lambda path, default: F.coalesce(F.col(f"a.{path}"), default)
    return rows.select(F.col(name).alias("name"), a.alias("a")).select(
        "name", F.col("a.State.Status").alias("status"), of("Config.Image", F.lit("unknown")).alias("image"), F.col("a.State.Health.Status").alias("health"), of("State.ExitCode", F.lit(0)).alias("exit_code"),
        of("RestartCount", F.lit(0)).alias("restart_count"), of("HostConfig.Privileged", F.lit(False)).alias("privileged"), of("HostConfig.Binds", F.array().cast("array<string>")).alias("binds"),
        of("HostConfig.NetworkMode", F.lit("")).alias("network_mode"), of("Config.User", F.lit("")).alias("user"),
    )


def process_table(lines: DataFrame, line: str = "line") -> DataFrame:
    """(pid, cpu, run_seconds, name, cmdline) of `pid cpu seconds name arguments` lines (S13); headings fall out."""
    part = r"^\s*(\d+)\s+([0-9.]+)\s+(\d+)\s+(\S+)\s*(.*)$"
    field = lambda i: F.regexp_extract(line, part, i)
    return lines.where(F.col(line).rlike(part)).select(field(1).cast("long").alias("pid"), field(2).cast("double").alias("cpu"), field(3).cast("long").alias("run_seconds"), field(4).alias("name"), field(5).alias("cmdline"))


def crontab(files: DataFrame) -> DataFrame:
    """(source, schedule, command) of a user's table: five fields and a command; shorter lines fall out."""
    fields = F.split("line", r"\s", 6)
    return _lines(files).where(F.size(fields) == 6).select(F.col("path").alias("source"), F.array_join(F.slice(fields, 1, 5), " ").alias("schedule"), F.element_at(fields, 6).alias("command"))


def cron_folders(files: DataFrame) -> DataFrame:
    """(source, schedule, command) of every line of files right in the folders of scheduled scripts."""
    folder = S.parent(F.col("path"))
    rows = _lines(files.where(folder.isin(CRON_FOLDERS)))
    return rows.select(F.concat(F.lit("cron:"), "path").alias("source"), S.parent(F.col("path")).alias("schedule"), F.col("line").alias("command"))


def timers(lines: DataFrame, units: DataFrame, line: str = "line") -> DataFrame:
    """(source, schedule, command) of timers, from `list-timers` lines and the (path, content) of the services that they start."""
    fields = F.split(S.stripped(line), r"\s+")
    service = lines.where(F.size(fields) >= 6).select(F.element_at(fields, -1).alias("service"), F.element_at(fields, -2).alias("timer"))
    starts = _lines(units).where(F.col("line").rlike("^ExecStart=")).select(S.basename(F.col("path")).alias("service"), F.regexp_replace("line", "^ExecStart=", "").alias("command"))
    return service.join(starts, "service").select(F.concat(F.lit("timer:"), "timer").alias("source"), F.col("timer").alias("schedule"), "command")


def environs(rows: DataFrame, key: str = "pid", text: str = "environ") -> DataFrame:
    """(pid, name, value) of a process's environment, whose entries end in zero bytes."""
    entry = F.explode(F.split(text, "\x00"))
    found = rows.select(key, entry.alias("entry")).where(F.col("entry").contains("="))
    return found.select(key, F.substring_index("entry", "=", 1).alias("name"), F.expr("substring(entry, locate('=', entry) + 1)").alias("value"))


def subscription(rows: DataFrame, key: str, json: str, section: str) -> DataFrame:
    """(key, type, tier, paid_tokens) of credential files, whose plan stands in a section (S9); texts that are no JSON are unknown."""
    whole = F.get_json_object(json, "$").isNotNull()
    of = lambda name, default: F.when(whole, F.coalesce(F.get_json_object(json, f"$.{section}.{name}"), F.lit(default))).otherwise("unknown")
    return rows.select(key, of("subscriptionType", "free").alias("type"), of("rateLimitTier", "").alias("tier"), (whole & F.get_json_object(json, "$.apiKey").isNotNull()).alias("paid_tokens"))


def service_status(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, indicator, description) of status pages that were fetched (S24); other indicators and texts are unknown."""
    indicator, description = F.get_json_object(json, "$.status.indicator"), F.get_json_object(json, "$.status.description")
    known = F.coalesce(indicator.isin(INDICATORS), F.lit(False))
    return rows.select(key, F.when(known, indicator).otherwise("unknown").alias("indicator"), F.when(known, description).when(indicator.isNotNull(), F.concat(F.lit("Unexpected indicator: "), indicator)).otherwise("Parse error").alias("description"))


def search_events(rows: DataFrame, json: str = "line") -> DataFrame:
    """(path, line_no, text) of the matches in a search tool's JSON event lines."""
    value = lambda path: F.get_json_object(json, f"$.data.{path}")
    found = rows.where(F.get_json_object(json, "$.type") == "match")
    return found.select(value("path.text").alias("path"), value("line_number").cast("long").alias("line_no"), F.regexp_replace(value("lines.text"), "\r?\n$", "").alias("text"))


def projects(files: DataFrame, depth: int = 2) -> DataFrame:
    """(project, name, compose, package) of folders that hold `.git`, down to a depth and not below one another or in hidden ones (S27), from the (path) of files."""
    folder = F.regexp_extract("path", r"^((?:[^/.][^/]*/)*[^/.][^/]*)/\.git/", 1)
    roots = files.select(folder.alias("project")).where(F.col("project") != "").distinct().where(S.depth(F.col("project")) < depth)
    above = roots.select("project", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("project", "/"))), lambda k: F.array_join(F.slice(F.split("project", "/"), F.lit(1), k), "/"))).alias("up")).where("up != project")
    roots = roots.join(above.join(roots.select(F.col("project").alias("up")), "up", "left_semi").select("project").distinct(), "project", "left_anti")
    held = files.select(S.parent(F.col("path")).alias("project"), S.basename(F.col("path")).alias("file")).groupBy("project").agg(F.bool_or(F.col("file").isin("docker-compose.yml", "docker-compose.yaml")).alias("compose"), F.bool_or(F.col("file") == "package.json").alias("package"))
    rows = roots.join(held, "project", "left").na.fill(False, ["compose", "package"])
    return rows.select("project", S.basename(F.col("project")).alias("name"), "compose", "package")


def notifiable(severity: Column, ts: Column, start: int, end: int, enabled: bool = True) -> Column:
    """Whether an alert is shown: switched on, critical or high, and outside the quiet hours."""
    return F.lit(enabled) & severity.isin("critical", "high") & ~state.quiet_hours(ts, start, end)


def _finding(rows: DataFrame, severity: Column | str, message: Column | str, source: str) -> DataFrame:
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select("host", F.lit("system").alias("type"), text(severity).alias("severity"), text(message).alias("message"), F.lit(source).alias("source"))


def firewall(rows: DataFrame) -> DataFrame:
    """Findings on (host, tool, active, details)."""
    off = rows.where(~F.col("active"))
    return _finding(off, "high", F.when(F.col("tool") == "none", "No firewall").otherwise(F.concat("tool", F.lit(" is inactive: "), "details")), "firewall")


def ssh_settings(rows: DataFrame) -> DataFrame:
    """Findings on (host, content) of sshd_config (D59): root login, empty passwords, passwords."""
    on = lambda key: F.col("content").rlike(rf"(?mi)^\s*{key}\s+yes\b")
    issues = F.array_compact(F.array(
        F.when(on("PermitRootLogin"), F.struct(F.lit("high").alias("s"), F.lit("root login").alias("m"))),
        F.when(on("PermitEmptyPasswords"), F.struct(F.lit("critical").alias("s"), F.lit("empty passwords").alias("m"))),
        F.when(on("PasswordAuthentication"), F.struct(F.lit("medium").alias("s"), F.lit("password login").alias("m"))),
    ))
    return _finding(rows.select("host", F.inline(issues)), F.col("s"), F.concat(F.lit("SSH: "), "m"), "sshd_config")


def updates(rows: DataFrame) -> DataFrame:
    """Findings on (host, update) descriptions; those about security are high."""
    return _finding(rows, F.when(F.lower("update").contains("security"), "high").otherwise("medium"), F.col("update"), "updates")


def sudoers(rows: DataFrame) -> DataFrame:
    """Hosts of (host, content) whose sudoers let someone do all without a password."""
    return _finding(rows.where(F.col("content").rlike(r"(?m)^[^#\n]*NOPASSWD:\s*ALL\b")), "medium", "Passwordless admin access for all commands", "sudoers")


def writable_path(rows: DataFrame) -> DataFrame:
    """Folders of (host, folder, mode) on the PATH that all may write to."""
    return _finding(rows.where(S.has_bits(F.col("mode"), 0o002)), "high", F.concat("folder", F.lit(" is world-writable")), "path")


def branch_findings(repos: DataFrame, unmerged: DataFrame) -> DataFrame:
    """(repo, severity, title) (D29): repositories of (repo, branch, commits) on their main branch, and counts of unmerged (repo, line) branches."""
    direct = repos.where(F.col("branch").isin("main", "master") & (F.col("commits") > 0)).select("repo", F.lit("low").alias("severity"), F.concat(F.lit("Working directly on "), "branch").alias("title"))
    open_ = unmerged.where(S.stripped("line") != "").groupBy("repo").agg(F.count("*").alias("n"))
    return direct.unionByName(open_.select("repo", F.lit("info").alias("severity"), F.concat(F.col("n").cast("string"), F.lit(" unmerged branches")).alias("title")))


def cheat_sheet(status: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo, commands) that fit the state of repositories (repo, branch, is_git), four at most (D31); status is (repo, line) of porcelain lines."""
    x, y = F.substring("line", 1, 1), F.substring("line", 2, 1)
    seen = status.groupBy("repo").agg(F.bool_or(F.col("line").startswith("??")).alias("untracked"), F.bool_or(y == "M").alias("modified"), F.bool_or(x.isin(list("AMDRC"))).alias("staged"))
    rows = repos.join(seen, "repo", "left")
    clean = F.col("untracked").isNull()
    commands = F.array_compact(F.array(
        F.when(F.col("untracked"), "git add (new file)"), F.when(F.col("modified"), "git add (change)"), F.when(F.col("staged"), "git commit"), F.when(F.col("modified") | F.col("untracked"), "git stash"),
        F.when(clean, "git log"), F.when(clean, "git diff"), F.when(F.col("branch").isin("main", "master"), "git checkout -b"),
    ))
    return rows.select("repo", F.when(~F.col("is_git"), F.array(F.lit("git init"), F.lit("git add ."), F.lit("git commit"))).otherwise(F.slice(commands, 1, 4)).alias("commands"))


def frontends(files: DataFrame) -> DataFrame:
    """(project, devtools, ui_dictionary): projects of (project, path) files that have a frontend."""
    ext, name = S.extension(F.col("path")), F.col("path")
    code = F.bool_or(ext.isin(FRONTEND_EXTENSIONS))
    return files.groupBy("project").agg((code | F.bool_or(name.isin(FRONTEND_FILES))).alias("devtools"), (code | F.bool_or(ext == "html")).alias("ui_dictionary")).where("devtools OR ui_dictionary")


def unknown_packages(deps: DataFrame, known: DataFrame) -> DataFrame:
    """(ecosystem, name, version) of dependencies that are not known, each name once, the first version by name."""
    once = deps.groupBy("ecosystem", F.lower("name").alias("name")).agg(F.min("version").alias("version"))
    return once.join(known.select("ecosystem", F.lower("name").alias("name")).distinct(), ["ecosystem", "name"], "left_anti").select("ecosystem", "name", "version")


def plain_cycles(pairs: DataFrame) -> DataFrame:
    """Mutual imports (a, b) without generated or mock modules (F16)."""
    made = lambda c: F.replace(F.col(c), F.lit("\\"), F.lit("/")).rlike("|".join(GENERATED_MODULES))
    return pairs.where(~made("a") & ~made("b"))


def reminder(projects_: DataFrame) -> DataFrame:
    """One standing note per project: look for what exists before building."""
    return projects_.select("project").distinct().select("project", F.lit("brake.opensource_check").alias("check_id"), F.lit("info").alias("severity"), F.lit("Search for an existing solution before building").alias("title"))
