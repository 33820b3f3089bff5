"""Security queries over the documents' texts with fragments planted in them.

Each text has up to two fragments of a table put in at places that its id picks, so they stand in the
midst of words, at ends and in one another.  The SQL doesn't know where: it looks for every entry of
the table in the text, as the operator does.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import scripts, security
from kestrel.plans.catalogue import register


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _planted(fragments: list[str], text: str = "text") -> str:
    """An expression that Spark and DuckDB both read: a text with two of the fragments put in, or one, or none."""
    place = lambda step: f"(doc_id * {step}) % (length({text}) + 1)"
    pick = lambda factor: f"split_part({_quoted('~'.join(fragments))}, '~', CAST((doc_id * {factor} + length({text})) % {2 * len(fragments) + 1} + 1 AS INT))"
    first, last = (f"CAST({f}({place(7919)}, {place(104_729)}) AS INT)" for f in ("least", "greatest"))
    return f"concat(substr({text}, 1, {first}), {pick(31)}, substr({text}, {first} + 1, {last} - {first}), {pick(17)}, substr({text}, {last} + 1))"


def _first(text: str, table: list[tuple[str, str]]) -> tuple[str, str]:
    """The first entry that a text contains, and its severity, in SQL."""
    return tuple("CASE " + " ".join(f"WHEN contains({text}, {_quoted(e[0])}) THEN {_quoted(e[i])}" for e in table) + " END" for i in (0, 1))


def _each(text: str, parts: list[str]) -> str:
    return "[" + ", ".join(f"CASE WHEN contains({text}, {_quoted(p)}) THEN {_quoted(p)} END" for p in parts) + "]"


_COMMANDS = _planted([part for part, _ in security.PROCESS_ARGS])
_NAMES = _planted([part.upper() for part, _ in security.PROCESS_NAMES], "source")
_ARGS_HIT, _NAME_HIT = _first("cmdline", security.PROCESS_ARGS), _first("lower(name)", security.PROCESS_NAMES)


@register(
    f"WITH p AS (SELECT doc_id, {_NAMES} AS name, {_COMMANDS} AS cmdline FROM documents) SELECT doc_id AS subject, 'process.args' AS rule, {_ARGS_HIT[1]} AS severity, {_ARGS_HIT[0]} AS detail FROM p WHERE {_ARGS_HIT[0]} IS NOT NULL "
    f"UNION ALL SELECT doc_id, 'process.name', {_NAME_HIT[1]}, {_NAME_HIT[0]} FROM p WHERE {_NAME_HIT[0]} IS NOT NULL AND cmdline <> ''"
)
def _planted_processes(spark, read):
    rows = read("documents").select(F.col("doc_id").alias("pid"), F.expr(_NAMES).alias("name"), F.expr(_COMMANDS).alias("cmdline"), F.lit("/usr/bin/x").alias("exe"), F.lit(1.0).alias("cpu"), F.lit(5).alias("run_seconds"))
    return security.processes(rows)


_TASKS = _planted([part for part, _ in security.SCHEDULED])
_TASK_HIT = _first("command", security.SCHEDULED)


@register(f"SELECT doc_id AS subject, 'scheduled.command' AS rule, {_TASK_HIT[1]} AS severity, {_TASK_HIT[0]} AS detail FROM (SELECT doc_id, {_TASKS} AS command FROM documents) WHERE {_TASK_HIT[0]} IS NOT NULL")
def _planted_schedules(spark, read):
    return security.scheduled(read("documents").select(F.col("doc_id").alias("source"), F.expr(_TASKS).alias("command")))


_LOCKED = _planted([*security.LOCK_ADDRESSES, *security.LOCK_COMMANDS, '"resolved": "http://', '"resolved": "https://'])
_LOCK_PATH = "concat(CASE WHEN doc_id % 11 = 0 THEN 'node_modules/' ELSE 'p/' END, split_part('package-lock.json~yarn.lock~pnpm-lock.yaml~Pipfile.lock~poetry.lock~go.sum', '~', CAST(doc_id % 6 AS INT) + 1))"


@register(
    f"WITH f AS (SELECT {_LOCK_PATH} AS path, {_LOCKED} AS content FROM documents), s AS (SELECT *, path LIKE '%json' OR path LIKE '%yarn.lock' OR path LIKE '%.yaml' AS js FROM f WHERE path LIKE 'p/%' AND path <> 'p/go.sum'), "
    f"h AS (SELECT path, 'supply.address' AS rule, 'high' AS severity, unnest({_each('content', security.LOCK_ADDRESSES)}) AS detail FROM s UNION ALL SELECT path, 'supply.command', 'critical', unnest({_each('content', security.LOCK_COMMANDS)}) FROM s WHERE js "
    "UNION ALL SELECT path, 'supply.plain_http', 'high', 'http://' FROM s WHERE js AND contains(content, '\"resolved\": \"http://')) SELECT path AS subject, rule, severity, detail FROM h WHERE detail IS NOT NULL"
)
def _planted_lock_files(spark, read):
    return security.lock_files(read("documents").select(F.expr(_LOCK_PATH).alias("path"), F.expr(_LOCKED).alias("content")))


_HOOKED = _planted([*security.HOOK_COMMANDS, *(c.upper() for c in security.HOOK_COMMANDS), "curl x", "wget", "| sh", "| bash"])
_HOOK_PATH = "concat('.git/hooks/', split_part('pre-commit~post-merge~pre-commit.sample~other', '~', CAST(doc_id % 4 AS INT) + 1))"
_HOOK_HIT = _first("lower(content)", [(c, "critical") for c in security.HOOK_COMMANDS])


@register(
    f"WITH f AS (SELECT {_HOOK_PATH} AS path, {_HOOKED} AS content FROM documents), s AS (SELECT * FROM f WHERE regexp_matches(path, 'hooks/({'|'.join(security.HOOKS)})[^/]*$') AND path NOT LIKE '%.sample') "
    f"SELECT path AS subject, 'hook.command' AS rule, 'critical' AS severity, {_HOOK_HIT[0]} AS detail FROM s WHERE {_HOOK_HIT[0]} IS NOT NULL "
    "UNION ALL SELECT path, 'hook.download_run', 'critical', 'download and run' FROM s WHERE (contains(content, 'curl') OR contains(content, 'wget')) AND (contains(content, '| sh') OR contains(content, '| bash'))"
)
def _planted_git_hooks(spark, read):
    return security.git_hooks(read("documents").select(F.expr(_HOOK_PATH).alias("path"), F.expr(_HOOKED).alias("content")))


#: One of each shape, and some that fall short of it.
_KEYS = [
    "AKIA" + "Q7" * 8, "AKIAQ7", "ghp_" + "a1" * 18, "ghx_" + "a1" * 18, "gho_" + "b" * 35, "sk-ant-" + "x-" * 20, "sk-" + "Ab1" * 14, "sk-short", "rk_live_" + "k9" * 10, "sk_test_" + "k9" * 10,
    "xoxb-" + "1234567890-ab", "xoxz-1234567890", "postgres://u:p@h", "mysql://u@h", "mongodb://a:b@",
]
_ENVIRON = _planted(_KEYS)
_KEY_CASE = "CASE " + " ".join(f"WHEN regexp_matches(t, {_quoted(p)}) THEN {_quoted(n)}" for n, p in security.CREDENTIALS) + " END"


@register(f"SELECT doc_id AS subject, 'credential' AS rule, 'high' AS severity, {_KEY_CASE} AS detail FROM (SELECT doc_id, {_ENVIRON} AS t FROM documents) WHERE {_KEY_CASE} IS NOT NULL")
def _planted_credentials(spark, read):
    texts = read("documents").select("doc_id", F.explode(F.array(F.expr(_ENVIRON))).alias("t"))  # made once, not once a pattern
    return security.credentials(texts, "doc_id", "t")


#: A script with the text in a comment, a template, a string and a method's body, and with members that are no methods.
_SAFE = "translate(replace(text, '*/', ''), concat('`', chr(36), chr(92)), '   ')"
_HEAD = f"concat('/* class No {{ a() {{}} }} ', {_SAFE}, ' */', chr(10), 'const s = `class X {{ ', {_SAFE}, '${{a ? `}}` : 1}}`;', chr(10))"
_SCRIPT = (
    f"concat({_HEAD}, 'export class K', doc_id, CASE WHEN doc_id % 7 = 0 THEN ' extends Error' WHEN doc_id % 7 = 1 THEN ' extends a.Base<{{x: 1}}>' ELSE '' END, ' {{', chr(10), CASE WHEN doc_id % 5 = 0 THEN 'constructor(private a = 1) {{}}' ELSE 'b = () => {{ go() }};' END, chr(10),"
    f" CASE WHEN length(text) % 4 > 0 THEN concat('run<T>(x?: T): {{y: 1}} | null {{ return `', {_SAFE}, '` }}', chr(10)) ELSE '' END, CASE WHEN length(text) % 4 > 1 THEN 'static async *go() {{ if (a < b) {{ /}}/.test(x) }} }} c(): void;' ELSE '' END, CASE WHEN length(text) % 4 > 2 THEN concat(chr(10), 'get d() {{ return 1 }}') ELSE '' END, '}}', chr(10))"
).replace("{{", "{").replace("}}", "}")
_HEAD = _HEAD.replace("{{", "{").replace("}}", "}")


@register(
    f"SELECT 'p' AS project, concat('d', doc_id, '.ts') AS path, length({_HEAD}) - length(replace({_HEAD}, chr(10), '')) + 1 AS line, concat('K', doc_id) AS name, CASE doc_id % 7 WHEN 0 THEN 'Error' WHEN 1 THEN 'Base' END AS base, length(text) % 4 AS methods, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS constructors FROM documents"
)
def _script_classes(spark, read):
    files = read("documents").select(F.lit("p").alias("project"), F.expr("concat('d', doc_id, '.ts')").alias("path"), F.expr(_SCRIPT.replace("'${a", "'$' || '{a")).alias("content"))
    return scripts.script_classes(files)
