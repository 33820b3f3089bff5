"""Source trees as DataFrames: (path, content) with paths relative to a root, and the selections on them."""

from __future__ import annotations

import re
import stat
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kestrel.functions import scalars as S

#: Folders that are never read.
SKIPPED = [
    "node_modules", ".git", "__pycache__", ".venv", "venv", ".tox", "dist", "build", ".next", ".nuxt", "target", ".mypy_cache", ".pytest_cache", ".ruff_cache",
    "env", ".egg-info", "vendor", ".gradle", ".idea", "out", "cmake-build-debug", "cmake-build-release", ".bundle", ".cache", "coverage", ".coverage", ".terraform",
]
#: Extensions of source files.
SOURCE_EXTENSIONS = ["py", "js", "ts", "jsx", "tsx", "mjs", "mts", "cjs", "cts", "rs", "go", "c", "h", "cpp", "hpp", "cc", "cxx", "hxx", "java", "kt", "kts", "rb", "php", "swift", "cs"]
#: Configuration files as (pattern, kind), the first match counts.
CONFIGS = [
    (".env", "env"), (".env.*", "env"), ("docker-compose*.yml", "docker"), ("docker-compose*.yaml", "docker"), ("Dockerfile*", "docker"),
    ("pyproject.toml", "python_deps"), ("setup.py", "python_deps"), ("setup.cfg", "python_deps"), ("requirements*.txt", "python_deps"), ("Pipfile", "python_deps"),
    ("package.json", "js_config"), ("tsconfig*.json", "js_config"), ("Makefile", "build"), ("Procfile", "build"),
    (".github/workflows/*.yml", "ci"), (".github/workflows/*.yaml", "ci"), (".gitlab-ci.yml", "ci"),
]


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression: `*` and `?` stay within a folder."""
    parts = {"*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(parts.get(c) or (c if c.isalnum() or c in "/_-" else f"[{c}]") for c in pattern) + "$"


def _store(root: str) -> tuple[fs.FileSystem, str]:
    found, path = fs.FileSystem.from_uri(root if re.match("[a-z0-9]+:", root) else f"file://{Path(root).absolute()}")
    return found, path.rstrip("/")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, modified) of all files below a root; bytes that are no UTF-8 are replaced.

    Spark's file sources hide names that begin with a dot or an underscore and leave out empty files, so
    the tree is read with pyarrow's file systems (any store they know; all machines must reach it).  The
    driver lists the top folder only, tasks list the folders below it, and the files that they find are
    dealt out anew, so that one large folder is read by many tasks; a task holds a file at a time.
    """
    store, base = _store(root)
    top = [(i.path, i.type == fs.FileType.Directory) for i in store.get_file_info(fs.FileSelector(base))]
    schema = pa.schema([("path", pa.string()), ("content", pa.string()), ("modified", pa.timestamp("us", "UTC"))])

    def listed(batches):
        store, _ = _store(root)
        for batch in batches:
            for entry in batch.to_pylist():
                found = store.get_file_info(fs.FileSelector(entry["path"], recursive=True)) if entry["folder"] else [store.get_file_info(entry["path"])]
                rows = [{"path": i.path, "modified": i.mtime} for i in found if i.type == fs.FileType.File]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([schema.field("path"), schema.field("modified")]))

    def read(batches):
        store, base = _store(root)
        for batch in batches:
            for i in batch.to_pylist():
                with store.open_input_stream(i["path"], compression=None) as stream:
                    row = {"path": i["path"][len(base) + 1 :], "content": stream.read().decode("utf-8", "replace"), "modified": i["modified"]}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    tasks = 4 * spark.sparkContext.defaultParallelism
    files = spark.createDataFrame(top, "path string, folder boolean").repartition(max(1, min(len(top), tasks))).mapInArrow(listed, "path string, modified timestamp")
    return files.repartition(tasks, "path").mapInArrow(read, "path string, content string, modified timestamp")


def read_meta(spark: SparkSession, root: str) -> DataFrame:
    """(path, mode, size, modified) of all files below a folder that every machine mounts (S21); what vanishes meanwhile is left out."""
    top = sorted(str(p) for p in Path(root).iterdir())
    kinds = [("path", pa.string()), ("mode", pa.int32()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC"))]

    def walk(batches):
        for batch in batches:
            for entry in batch.column(0).to_pylist():
                rows = []
                for path in [Path(entry)] if not Path(entry).is_dir() else Path(entry).rglob("*"):
                    try:
                        found = path.lstat()
                    except OSError:
                        continue
                    if stat.S_ISREG(found.st_mode):
                        rows.append({"path": str(path), "mode": stat.S_IMODE(found.st_mode), "size": found.st_size, "modified": int(found.st_mtime * 1e6)})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    tasks = max(1, min(len(top), 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame([(t,) for t in top], "path string").repartition(tasks).mapInArrow(walk, "path string, mode int, size long, modified timestamp")


def ignored_by(path: Column, patterns: list[str]) -> Column:
    """Whether ignore patterns hide a path: the last that matches decides, `!` takes back, `/` at the end means folders."""
    hidden = F.lit(False)
    for line in patterns:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        back, body = line.startswith("!"), line.lstrip("!")
        anchored = "/" in body.rstrip("/")
        core = glob_regex(body.strip("/").replace("**/", "").replace("/**", "")).strip("^$")
        hit = path.rlike(("^" if anchored and "**" not in body else "(^|/)") + core + ("/" if body.endswith("/") else "(/|$)"))
        hidden = F.when(hit, not back).otherwise(hidden)
    return hidden


def without_ignored(tree: DataFrame, name: str = ".gitignore") -> DataFrame:
    """Files of (path, content, ...) that no ignore file of their folder or one above hides; those of deeper folders decide, then later lines.

    Rules come from the tree itself: files meet those of their folders by equality, and a rule is tried
    on the path below its own folder.
    """

    def rules(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                folder = path.rpartition("/")[0]
                for no, line in enumerate((content or "").splitlines()):
                    body = line.rstrip().removeprefix("!")
                    if not body or body.startswith("#"):
                        continue
                    inner = body.strip("/")
                    steps = [".*" if s == "**" else glob_regex(s)[1:-1] for s in inner.split("/")]
                    core = "/".join(steps).replace(".*/", "(.*/)?").replace("/.*", "/.*")
                    start = "^" if "/" in body.rstrip("/") else "(^|/)"
                    out.append((folder, folder.count("/") + bool(folder), no, start + core + ("/" if body.endswith("/") else "(/|$)"), line.startswith("!")))
            yield pd.DataFrame(out, columns=["folder", "depth", "no", "regex", "back"])

    own = tree.where(S.basename(F.col("path")) == name).select("path", "content").mapInPandas(rules, "folder string, depth int, no int, regex string, back boolean")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    paths = tree.select("path", F.explode(above).alias("folder"))
    below = F.when(F.col("folder") == "", F.col("path")).otherwise(F.expr("substring(path, length(folder) + 2)"))
    met = paths.join(own, "folder").withColumn("below", below).where(F.expr("below rlike regex"))
    hidden = met.groupBy("path").agg(F.max_by("back", F.struct("depth", "no")).alias("back")).where("not back").select("path")
    return tree.join(hidden, "path", "left_anti")


def source_files(files: DataFrame, extensions: list[str] | None = None, skip_generated: bool = True, max_depth: int | None = None, ignore: list[str] | None = None) -> DataFrame:
    """Source files outside skipped, ignored and virtual-environment folders (S1); a depth is folders above the file."""
    path = F.col("path")
    rows = files.withColumn("path", F.regexp_replace("path", r"\\", "/"))
    folders = "|".join(s.replace(".", "[.]") for s in SKIPPED)
    rows = rows.where(S.extension(path).isin(extensions or SOURCE_EXTENSIONS) & ~path.rlike(f"(^|/)({folders})/"))
    if skip_generated:
        rows = rows.where(~S.is_generated(path))
    if max_depth is not None:
        rows = rows.where(S.depth(path) <= max_depth)
    if ignore:
        rows = rows.where(~ignored_by(path, ignore))
    environments = files.where(S.basename(path) == "pyvenv.cfg").select(S.parent(path).alias("_folder")).distinct()
    above = F.transform(F.sequence(F.lit(0), S.depth(path)), lambda k: F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/"))
    inside = rows.select("path", F.explode(above).alias("_folder")).join(environments, "_folder", "left_semi").select("path").distinct()
    return rows.join(inside, "path", "left_anti")


def raw_files(files: DataFrame, extensions: list[str], excluded: list[str]) -> DataFrame:
    """Files by extension, without those whose path holds an excluded part."""
    return files.where(S.extension(F.col("path")).isin(extensions) & ~F.col("path").rlike("|".join(e.replace(".", "[.]") for e in excluded) or "(?!)"))


def subset(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Source files that a list names; missing, generated and other files fall out without a word (S3)."""
    return files.where(S.extension(F.col("path")).isin(SOURCE_EXTENSIONS) & ~S.is_generated(F.col("path"))).join(paths.select("path"), "path", "left_semi")


def has_extension(files: DataFrame, extension: str, max_depth: int = 3) -> DataFrame:
    """One row (found)."""
    hit = (S.extension(F.col("path")) == extension) & (S.depth(F.col("path")) <= max_depth)
    return files.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("found"))


def configs(files: DataFrame) -> DataFrame:
    """(path, kind, variables) of configuration files, the first pattern counts; variables are set lines of .env files."""
    path = F.col("path")
    kind = F.coalesce(*(F.when(path.rlike(glob_regex(p)), k) for p, k in CONFIGS))
    variables = F.size(F.filter(F.split(F.coalesce("content", F.lit("")), "\r?\n"), lambda x: x.contains("=") & ~F.ltrim(x).startswith("#"))).cast("long")
    return files.select("path", kind.alias("kind"), F.when(kind == "env", variables).alias("variables")).where("kind IS NOT NULL")


def file_tree(files: DataFrame) -> DataFrame:
    """One row: files, folders, bytes and greatest depth (A10, D1); an empty table gives zeros."""
    folders = F.count_distinct(F.when(S.parent(F.col("path")) != "", S.parent(F.col("path"))))
    return files.agg(F.count("*").alias("files"), folders.alias("folders"), F.coalesce(F.sum(F.octet_length("content").cast("long")), F.lit(0)).alias("bytes"), F.coalesce(F.max(S.depth(F.col("path"))), F.lit(0)).alias("depth"))


def latest_per_project(files: DataFrame) -> DataFrame:
    """(project, modified) of the newest file of each top folder."""
    return files.groupBy(F.substring_index("path", "/", 1).alias("project")).agg(F.max("modified").alias("modified"))


def features(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(feature, files) by top folder, largest first; files of no known feature go under `other`."""
    top = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise("other")
    rows = files.select(top.alias("feature"))
    if known is not None:
        rows = rows.join(known.select("feature", F.lit(True).alias("_k")).distinct(), "feature", "left").select(F.when(F.col("_k"), F.col("feature")).otherwise("other").alias("feature"))
    return rows.groupBy("feature").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "feature")
