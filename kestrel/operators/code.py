"""Source-code analytics: extracted facts, unused imports and definitions, module resolution, debt and size.

`files` is (project, path, content), path relative to its project with forward slashes.  One pass
(`facts`) parses each Python file once and gives tagged rows; the detectors are joins and filters on
them.  Nothing here needs more than one file in a task at a time.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kestrel.functions import scalars as S
from kestrel.operators import scripts

FACTS = "project string, path string, kind string, name string, module string, original string, owner string, statement string, line long, n long, top boolean, flag boolean"

#: Methods that test runners call by themselves.
TEST_LIFECYCLE = [
    "setup_function", "teardown_function", "setup_method", "teardown_method", "setup_class", "teardown_class", "setup_module", "teardown_module",
    "setUp", "tearDown", "setUpClass", "tearDownClass", "setUpModule", "tearDownModule", "asyncSetUp", "asyncTearDown",
]
#: Methods that frameworks call by themselves.
CALLBACKS = [
    "on_modified", "on_created", "on_deleted", "on_moved", "on_closed", "on_any_event",
    "paintEvent", "resizeEvent", "closeEvent", "showEvent", "hideEvent", "keyPressEvent", "keyReleaseEvent", "mousePressEvent", "mouseReleaseEvent", "mouseMoveEvent",
    "wheelEvent", "dragEnterEvent", "dragMoveEvent", "dropEvent", "focusInEvent", "focusOutEvent", "enterEvent", "leaveEvent", "timerEvent", "changeEvent",
    "contextMenuEvent", "eventFilter", "sizeHint", "minimumSizeHint", "retranslateUi", "retranslate",
    "get_queryset", "get_context_data", "get_serializer_class", "get_permissions", "get_form_class", "get_form_kwargs", "get_success_url", "get_redirect_url",
    "get_object", "perform_create", "perform_update", "perform_destroy", "form_valid", "form_invalid", "add_arguments",
    "on_startup", "on_shutdown", "on_success", "on_failure", "on_retry", "model_post_init",
    "has_add_permission", "has_change_permission", "has_delete_permission", "has_view_permission", "has_module_permission", "get_readonly_fields", "get_list_display",
    "get_list_filter", "get_search_fields", "get_fieldsets", "get_inline_instances", "get_urls", "save_model", "delete_model", "get_changeform_initial_data",
    "compose", "on_mount", "on_unmount", "on_show", "on_hide", "on_focus", "on_blur", "on_key", "on_resize", "on_idle", "watch_dark", "render",
    "setUp", "tearDown", "setUpClass", "tearDownClass",
    "handle_starttag", "handle_endtag", "handle_startendtag", "handle_data", "handle_entityref", "handle_charref", "handle_comment", "handle_decl", "handle_pi", "unknown_decl",
    "startElement", "endElement", "startElementNS", "endElementNS", "characters", "ignorableWhitespace", "processingInstruction", "startDocument", "endDocument",
    "startPrefixMapping", "endPrefixMapping",
]
#: Starts of methods that frameworks find by name.
CALLBACK_STARTS = ["validate_", "clean_", "action_", "watch_", "on_"]
#: Base classes whose subclasses may well have a single method.
FRAMEWORK_BASES = [
    "QThread", "QRunnable", "QDialog", "QWidget", "QMainWindow", "QFrame", "QGroupBox", "QAbstractTableModel", "QAbstractItemModel", "QStyledItemDelegate",
    "QSortFilterProxyModel", "QTextEdit", "QPlainTextEdit", "QLineEdit", "QLabel", "QGraphicsView", "Thread", "Process", "BaseCommand", "View", "APIView", "ViewSet",
    "ModelViewSet", "Serializer", "ModelSerializer", "Migration", "AppConfig", "Middleware", "Model", "Manager", "QuerySet", "Form", "ModelForm", "Resource", "Exception",
    "Error", "TestCase", "Enum", "IntEnum", "StrEnum", "Protocol", "ABC", "TypedDict", "NamedTuple", "BaseModel",
]
#: Folders and endings of files whose classes may well have a single method.
SINGLE_METHOD_FOLDERS = ["migrations", "commands", "upgrade-version-command", "alembic/versions"]
SINGLE_METHOD_ROLES = ["command", "migration", "guard", "interceptor", "pipe", "strategy", "filter", "middleware", "decorator", "listener"]
SINGLE_METHOD_ENDINGS = [".job.py", ".command.py", "_migration.py"]
#: Files that start programs.
PYTHON_ENTRIES = ["main.py", "app.py", "manage.py", "wsgi.py", "asgi.py", "__main__.py", "run.py", "server.py", "cli.py"]
JS_ENTRIES = ["index.js", "index.ts", "index.jsx", "index.tsx", "index.mjs", "index.mts", "app.js", "app.ts", "app.jsx", "app.tsx", "server.js", "server.ts", "main.js", "main.ts"]
#: Files that tools or frameworks load, so that no import leads to them: folders, endings and names.
LOADED_FOLDERS = ["migrations", "alembic"]
LOADED_ENDINGS = [
    "__init__.py", "conftest.py", "setup.py", "manage.py", "wsgi.py", "asgi.py", ".rs", ".go", ".h", ".hpp", ".hxx", ".java", ".kt", ".kts",
    ".config.js", ".config.ts", ".config.mjs", ".config.cjs", "settings.py", "robots.ts", "sitemap.ts", "middleware.ts", "middleware.js", ".d.ts",
]
LOADED_NAMES = [
    "admin.py", "apps.py", "urls.py", "signals.py", "receivers.py", "tasks.py", "layout.tsx", "layout.jsx", "layout.js", "page.tsx", "page.jsx", "page.js",
    "loading.tsx", "loading.jsx", "error.tsx", "error.jsx", "not-found.tsx", "not-found.jsx", "template.tsx", "template.jsx", "default.tsx", "default.jsx", "sidebars.ts", "sidebars.js",
]
#: Addresses that may stand in code.
PLAIN_HOSTS = ["localhost", "127.0.0.1", "example.com", "schema.org", "w3.org", "github.com", "pypi.org", "npmjs.com"]
#: Packages that are too large to import whole.
HEAVY_PACKAGES = ["react-icons", "lodash", "@mui/icons", "@fortawesome", "heroicons"]


# ---- facts


class _Reader(ast.NodeVisitor):
    """Collects the facts of a module: what it binds, defines, uses and leaves untyped."""

    def __init__(self, text: str):
        self.lines, self.rows, self.used, self.stack, self.typing = text.splitlines(), [], set(), [], 0

    def add(self, kind: str, line: int, **more) -> None:
        self.rows.append({"kind": kind, "line": line, "top": not self.stack} | more)

    def visit_Import(self, node):
        for a in node.names:
            self.add("import", node.lineno, name=a.asname or a.name.partition(".")[0], module=a.name, original=a.name, statement=ast.unparse(node), flag=False)

    def visit_ImportFrom(self, node):
        origin = "." * node.level + (node.module or "")
        for a in node.names:
            if a.name == "*":
                self.add("star", node.lineno, module=origin)
            else:
                module = origin + ("" if origin.endswith(".") else ".") + a.name
                self.add("import", node.lineno, name=a.asname or a.name, module=module, original=a.name, statement=ast.unparse(node), flag=self.typing > 0)

    def visit_If(self, node):
        typing = isinstance(node.test, ast.Name) and node.test.id == "TYPE_CHECKING"
        self.visit(node.test)
        self.typing += typing
        for child in node.body + node.orelse:
            self.visit(child)
        self.typing -= typing

    def _define(self, node, kind: str, **more) -> None:
        decorated = any(d.end_lineno + 1 == node.lineno for d in node.decorator_list)
        owner = self.stack[-1].name if self.stack and isinstance(self.stack[-1], ast.ClassDef) else None
        self.add(kind, node.lineno, name=node.name, owner=owner, flag=decorated, **more)

    def visit_ClassDef(self, node):
        own = [m.name for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)) and not m.decorator_list]
        bases = [b.id if isinstance(b, ast.Name) else b.attr for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
        single = sum(not m.startswith("__") for m in own) == 1 and len(own) <= 2
        self._define(node, "class", n=len(own))
        if single and not self.stack and not node.decorator_list and not set(bases) & set(FRAMEWORK_BASES):
            self.add("single_method", node.lineno, name=node.name)
        self._inside(node)

    def _function(self, node):
        self._define(node, "method" if self.stack and isinstance(self.stack[-1], ast.ClassDef) else "function")
        args = node.args
        plain = [*args.posonlyargs, *args.args]
        defaults = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
        params = [(a, d) for a, d in [*zip(plain, defaults, strict=True), *zip(args.kwonlyargs, args.kw_defaults, strict=True)] if a.arg not in ("self", "cls") or a.annotation or d]
        untyped = sum(a.annotation is None for a, _ in params)
        counted = sum(a.annotation is None or d is None for a, d in params)
        routed = node.decorator_list and re.search(r"router\.|app\.", self.lines[node.decorator_list[0].lineno - 1])
        if not node.name.startswith(("__", "test_")) and not routed and (untyped or (node.returns is None and counted)):
            self.add("untyped", node.lineno, name=node.name, n=untyped, flag=node.returns is None)
        self.used |= {a.arg for a in (*plain, *args.kwonlyargs, args.vararg, args.kwarg) if a}
        self._inside(node)

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def _inside(self, node) -> None:
        self.stack.append(node)
        self.generic_visit(node)
        self.stack.pop()

    def visit_ExceptHandler(self, node):
        if node.type is None:
            self.add("bare_except", node.lineno)
        if all(isinstance(b, ast.Pass) for b in node.body):
            self.add("except_pass", node.lineno)
        self.generic_visit(node)

    def visit_Name(self, node):
        self.used.add(node.id)

    def visit_Attribute(self, node):
        self.used.add(node.attr)
        self.visit(node.value)

    def visit_keyword(self, node):
        self.used |= {node.arg} - {None}
        self.visit(node.value)


def _read(text: str) -> list[dict]:
    """Facts of a text; one that does not parse gives its imports and identifiers by line patterns."""
    try:
        reader = _Reader(text)
        reader.visit(ast.parse(text))
        found = reader.rows + [{"kind": "use", "name": u} for u in reader.used]
        return [*found, {"kind": "file", "flag": True, "n": len(reader.lines)}]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        rows = []
        for i, line in enumerate(text.splitlines(), 1):
            for origin, names in re.findall(r"^\s*(?:from\s+([.\w]+)\s+)?import\s+\(?([\w., ]+)", line):
                for part in filter(None, (p.strip() for p in names.split(","))):
                    original, _, alias = part.partition(" as ")
                    module = f"{origin}{'' if origin.endswith('.') else '.'}{original}" if origin else original
                    name = alias.strip() or (original if origin else original.partition(".")[0])
                    rows.append({"kind": "import", "name": name, "module": module, "original": original, "statement": line.strip(), "line": i, "top": not line[:1].isspace(), "flag": False})
            if not re.match(r"\s*(from|import)\s", line):
                rows += [{"kind": "use", "name": w} for w in set(re.findall(r"[A-Za-z_]\w*", line))]
        return [*rows, {"kind": "file", "flag": False, "n": len(text.splitlines())}]


def facts(files: DataFrame) -> DataFrame:
    """Tagged rows of every Python file (E1, E2): import, star, function, method, class, single_method, untyped,
    bare_except, except_pass, use (distinct in a file) and file (flag: it parsed).  Null texts count as empty."""
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in FACTS.split(", "))])

    def read(batches):
        for batch in batches:
            for file in batch.to_pylist():
                rows = [{"project": file["project"], "path": file["path"]} | r for r in _read(file["content"] or "")]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.where(F.col("path").endswith(".py")).select("project", "path", "content").mapInArrow(read, FACTS)


# ---- dead code


def is_test_scope(path: Column) -> Column:
    """F3."""
    return path.rlike(r"(^|/)tests/|(^|/)conftest\.py$|(^|/)test_[^/]*\.py$|_test\.py$")


def silenced(line: Column) -> Column:
    """Whether a line's marker silences unused imports: a bare one, or one that lists F401."""
    rest = F.regexp_extract(F.lower(line), "# noqa(.*)$", 1)
    return F.lower(line).contains("# noqa") & (~rest.rlike(r"^\s*:") | rest.rlike(r"^\s*:(.*[,\s])?f401([,\s]|$)"))


def _word_on(line: Column, name: Column) -> Column:
    """Whether the first place of a name in a line is a whole word (F8)."""
    at = F.position(name, line)
    return (at > 0) & ~F.substring(line, at - 1, F.when(at > 1, 1).otherwise(0)).rlike("[A-Za-z0-9_]") & ~F.substring(line, at + F.length(name), F.lit(1)).rlike("[A-Za-z0-9_]")


def unused_imports(files: DataFrame, found: DataFrame) -> DataFrame:
    """(project, path, line, name) of imports that their file doesn't use.

    Left out: package initialisers, files with star imports, imports for type checks only, silenced
    lines, model imports beside create_all, test frameworks in tests, names that stand on another line.
    """
    key = ["project", "path"]
    imports = found.where("kind = 'import' AND NOT flag").where(~F.col("path").endswith("__init__.py")).select(*key, "line", "name", "statement")
    imports = imports.join(found.where("kind = 'star'").select(key).distinct(), key, "left_anti")
    imports = imports.join(found.where("kind = 'use'").select(*key, "name"), [*key, "name"], "left_anti")
    # A file's imports travel together, so that its text does once.
    own = imports.groupBy(*key).agg(F.collect_list(F.struct("line", "name", "statement")).alias("imports"))
    rows = own.join(files.select(*key, "content"), key).withColumn("lines", F.split("content", "\r?\n"))
    numbered = F.transform("lines", lambda text, i: F.struct(text.alias("t"), (i + 1).alias("i")))
    elsewhere = lambda x: F.exists(numbered, lambda y: (y["i"] != x["line"]) & _word_on(y["t"], x["name"]))
    own_line = lambda x: F.coalesce(F.get(F.col("lines"), x["line"].cast("int") - 1), F.lit(""))
    model = lambda x: F.col("content").contains("create_all") & F.lower(x["statement"]).contains("model")
    framework = lambda x: x["name"].isin("pytest", "unittest") & is_test_scope(F.col("path"))
    left = F.filter("imports", lambda x: ~((F.octet_length(x["name"]) >= 2) & elsewhere(x)) & ~silenced(own_line(x)) & ~model(x) & ~framework(x))
    return rows.select(*key, F.inline(left)).select(*key, "line", "name")


def unused_definitions(found: DataFrame) -> DataFrame:
    """(project, path, line, name, kind) of definitions whose name no file of the project uses."""
    used = found.where("kind = 'use'").select("project", "name")
    exported = found.where("kind = 'import'").where(F.col("path").endswith("__init__.py"))
    used = used.union(exported.select("project", "name")).union(exported.select("project", "original")).distinct()
    name, kind, path = F.col("name"), F.col("kind"), F.col("path")
    starts = lambda words: name.rlike(f"^({'|'.join(words)})")
    called = starts(["__", "test_"]) | (is_test_scope(path) & name.isin(TEST_LIFECYCLE)) | ((kind == "method") & (name.isin(CALLBACKS) | starts(CALLBACK_STARTS)))
    named = (name == "Meta") | name.startswith("Test") | (name.endswith("Config") & path.endswith("apps.py"))
    rows = found.where(kind.isin("function", "method", "class") & ~F.col("flag") & ~F.when(kind == "class", named).otherwise(called))
    rows = rows.where(~name.startswith("_") & ~path.endswith("__init__.py") & ~path.rlike("(alembic|migrations)/versions/"))
    return rows.join(used, ["project", "name"], "left_anti").select("project", "path", "line", "name", "kind")


def parses(text: Column) -> Column:
    """Whether a text is valid Python."""

    @F.pandas_udf("boolean")
    def check(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t is not None and _read(t)[-1]["flag"])

    return check(text)


def commented_code(files: DataFrame, least: int = 5) -> DataFrame:
    """(project, path, first_line, length) of runs of comment lines that hold code.

    The text without its marks must parse, be code-like on half of its lines or more, and hold a
    statement that is more than a name or a constant.
    """
    line = F.posexplode(F.split("content", "\r?\n")).alias("pos", "line")
    lines = files.where(F.col("path").endswith(".py")).select("project", "path", line).where(r"line rlike '^\\s*#' AND NOT line rlike '^#!|coding[:=]'")
    lines = lines.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("project", "path").orderBy("pos")))
    bare = F.regexp_replace("line", r"^\s*# ?", "")
    code = bare.rlike(r"[=(){}\[\]]|^\s*(def|class|return|import|from|if|for|while|try|except|else|with|raise|pass)\b.*")
    runs = lines.groupBy("project", "path", "island").agg(
        F.min("pos").alias("first"), F.count("*").alias("length"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", bare.alias("t")))), lambda x: x.t), "\n").alias("text"), F.avg(code.cast("int")).alias("share")
    )
    solid = F.col("text").rlike(r"(?m)^\s*(def|class|return|import|from|if|for|while|try|with|raise)\b|[=(]")
    return runs.where((F.col("length") >= least) & (F.col("share") >= 0.5) & solid).where(parses(F.col("text"))).select("project", "path", (F.col("first") + 1).cast("long").alias("first_line"), "length")


# ---- modules


def _python_targets(files: DataFrame) -> DataFrame:
    """Files by the keys that an import may name them by: as they are, below src/ and below packages/x/."""
    base = files.select("project", F.col("path").alias("dst")).where(F.col("dst").endswith(".py"))
    ways = F.array(
        F.struct(F.lit(0).alias("rank"), F.col("dst").alias("key")),
        F.struct(F.lit(1).alias("rank"), F.regexp_extract("dst", "^src/(.+)$", 1).alias("key")),
        F.struct(F.lit(2).alias("rank"), F.regexp_extract("dst", "^packages/[^/]+/(.+)$", 1).alias("key")),
    )
    return base.select("project", "dst", F.inline(ways)).where("key != ''")


def resolve_python(files: DataFrame, found: DataFrame) -> DataFrame:
    """(project, src, dst, line, top) of imports that lead to a file of the project.

    Candidates are the import's prefixes as modules and packages from the root, src/, packages/x/ and the
    importer's folder, in this order and the longest first; one equi-join finds all, the least rank wins.
    """
    rows = found.where("kind IN ('import', 'star')").select("project", F.col("path").alias("src"), "line", "top", F.col("module").alias("m"))
    up = F.length(F.regexp_extract("m", r"^(\.*)", 1))
    steps = F.filter(F.split(S.parent(F.col("src")), "/"), lambda s: s != "")
    rows = rows.withColumn("up", up).withColumn("steps", steps).withColumn("parts", F.split(F.expr("substring(m, up + 1)"), r"\.")).where("m != '' AND parts[0] != '' AND up - 1 <= size(steps)")
    rows = rows.withColumn("own", F.when(F.col("up") > 0, F.expr("slice(steps, 1, size(steps) - up + 1)")).otherwise(F.col("steps")))
    bases = F.when(F.col("up") > 0, F.array(F.struct(F.lit(3).alias("b"), F.col("own").alias("base")))).otherwise(
        F.array(F.struct(F.lit(0).alias("b"), F.array().cast("array<string>").alias("base")), F.struct(F.lit(3).alias("b"), F.col("own").alias("base")))
    )
    rows = rows.select("project", "src", "line", "top", "m", "parts", F.inline(bases)).withColumn("take", F.explode(F.sequence(F.lit(1), F.size("parts"))))
    stem = F.array_join(F.concat("base", F.expr("slice(parts, 1, take)")), "/")
    rows = rows.select("project", "src", "line", "top", "m", "b", "take", F.posexplode(F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py")))).alias("init", "key"))
    hits = rows.join(_python_targets(files), ["project", "key"]).where("b = 0 OR rank = 0")
    best = F.min(F.struct((F.col("b") + F.col("rank")).alias("r"), (-F.col("take")).alias("t"), "init", "dst")).alias("best")
    return hits.groupBy("project", "src", "line", "top", "m").agg(best).select("project", "src", F.col("best.dst").alias("dst"), "line", "top").distinct()


JS_IMPORT = r"""(?:from\s*|import\s*\(?\s*|require\s*\(\s*)['"]([^'"]+)['"]"""


def js_imports(files: DataFrame) -> DataFrame:
    """(project, src, target) of what scripts import, require or export from; comments are taken out first."""
    bare = F.regexp_replace(F.regexp_replace("content", r"(?s)/\*.*?\*/", " "), r"(?m)(^|\s)//.*$", " ")
    seen = files.where(S.extension(F.col("path")).isin("js", "ts", "jsx", "tsx", "mjs", "mts", "cjs", "cts"))
    return seen.select("project", F.col("path").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(bare, F.lit(JS_IMPORT), F.lit(1)))).alias("target"))


def resolve_js(files: DataFrame) -> DataFrame:
    """(project, src, dst) of script imports that lead to a file of the project.

    Relative ones start at the importer's folder; `@/`, `~/`, `src/` and `test/` at its nearest folder
    with a tsconfig, or the root; other names are packages.  Extensions and index files are tried in order.
    """
    paths = files.select("project", "path")
    imports = js_imports(files).where(F.col("target").rlike(r"^(\.|@/|~/|src/|test/)"))
    steps = F.filter(F.split(S.parent(F.col("src")), "/"), lambda s: s != "")
    folders = imports.select("project", "src").distinct().withColumn("s", steps)
    folders = folders.select("project", "src", F.explode(F.transform(F.sequence(F.lit(0), F.size("s")), lambda k: F.array_join(F.slice("s", F.lit(1), k), "/"))).alias("folder"))
    config = paths.where(S.basename(F.col("path")).isin("tsconfig.json", "tsconfig.app.json")).select("project", S.parent(F.col("path")).alias("folder")).distinct()
    roots = folders.join(config, ["project", "folder"]).groupBy("project", "src").agg(F.max_by("folder", F.length("folder")).alias("root"))
    rows = imports.join(roots, ["project", "src"], "left")
    root = F.when(F.coalesce("root", F.lit("")) == "", "").otherwise(F.concat("root", F.lit("/")))
    rest = F.regexp_replace("target", "^[@~]/", "")
    bases = F.when(F.col("target").rlike(r"^\."), F.array(F.concat_ws("/", S.parent(F.col("src")), "target"))).when(
        F.col("target").rlike("^[@~]/"), F.array(*(F.concat(root, F.lit(p), rest) for p in ("", "src/", "src/modules/")))
    ).otherwise(F.array(F.concat(root, F.col("target"))))
    rows = rows.select("project", "src", "target", F.posexplode(bases).alias("b", "base")).withColumn("base", S.normal_path(F.ltrim("base", F.lit("/"))))
    ends = F.array(F.lit(""), *(F.lit(e) for x in ("js", "ts", "jsx", "tsx", "mjs", "mts") for e in (f".{x}", f"/index.{x}")))
    rows = rows.select("project", "src", "target", "b", F.col("base"), F.posexplode(ends).alias("e", "end")).withColumn("path", F.concat("base", "end"))
    best = F.min(F.struct("b", "e", "path")).alias("best")
    return rows.join(paths, ["project", "path"]).groupBy("project", "src", "target").agg(best).select("project", "src", F.col("best.path").alias("dst")).distinct()


def is_loaded(path: Column) -> Column:
    """Files that tools load or tests hold, so that no import is missed."""
    words = lambda xs: "|".join(x.replace(".", r"\.") for x in xs)
    return S.is_generated(path) | S.is_test_path(path) | path.rlike(f"/({words(LOADED_FOLDERS)})/|({words(LOADED_ENDINGS)})$|/({words(LOADED_NAMES)})$")


def entry_points(files: DataFrame) -> DataFrame:
    """(project, path, kind) of files that start a program, the first rule that holds."""
    name, text, ext = F.lower(S.basename(F.col("path"))), F.col("content"), S.extension(F.col("path"))
    small = F.octet_length(text) <= 50_000
    kind = (
        F.when((F.col("path") == "package.json") & text.rlike('"(main|start|dev|serve)"'), "package_json")
        .when(name == "manage.py", "django_manage")
        .when(name == "__main__.py", "python_package_main")
        .when(name.isin("wsgi.py", "asgi.py"), "python_wsgi")
        .when(name.isin(PYTHON_ENTRIES), "python_main")
        .when(name.isin(JS_ENTRIES), "js_entry")
        .when(small & (ext == "py") & text.contains("if __name__") & text.contains("__main__"), "python_main_guard")
        .when(small & ext.isin("js", "ts", "mjs", "mts") & text.rlike(r"createServer|\.listen\(|createApp|express\(\)"), "js_server")
    )
    return files.where(S.depth(F.col("path")) < 6).select("project", "path", kind.alias("kind")).where("kind IS NOT NULL")


def orphans(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, path) of files that nothing imports, that start no program and that no tool loads."""
    key = ["project", "path"]
    seen = files.where(~is_loaded(F.col("path"))).select(key)
    return seen.join(edges.select("project", F.col("dst").alias("path")).distinct(), key, "left_anti").join(entry_points(files).select(key), key, "left_anti")


# ---- debt and size


def _lines(files: DataFrame) -> DataFrame:
    line = F.posexplode(F.split(F.regexp_replace("content", "\r?\n$", ""), "\r?\n")).alias("pos", "line")
    return files.select("project", "path", line).select("project", "path", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def hardcoded(files: DataFrame) -> DataFrame:
    """(project, path, line_no, kind, value) of quoted addresses, long sleeps and long timeouts."""
    lines = _lines(files).where(~S.stripped("line").rlike(r"^(#|//|\*|assert|expect\()"))
    pick = lambda kind, pattern: F.transform(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    found = F.concat(pick("url", "[\"'](https?://[^\"']+)[\"']"), pick("sleep", r"sleep\((\d+)\)"), pick("timeout", r"setTimeout\([^,]+,\s*(\d+)\)"))
    rows = lines.select("project", "path", "line_no", F.inline(found))
    number = F.col("value").try_cast("bigint")
    plain = F.col("value").rlike("|".join(h.replace(".", r"\.") for h in PLAIN_HOSTS))
    return rows.where(F.when(F.col("kind") == "url", ~plain).when(F.col("kind") == "sleep", number > 10).otherwise(number > 10_000))


def todos(files: DataFrame) -> DataFrame:
    """(project, path, line_no, kind, text) of the first marker on each comment line."""
    line = S.stripped("line")
    lines = _lines(files).withColumn("line", line).where(F.col("line").rlike(r"^#|^//|# |// "))
    pattern = r"(?i)\b(TODO|FIXME|HACK|XXX|TEMP)\b(.*)"
    text = S.stripped(F.regexp_replace(S.stripped(F.regexp_extract("line", pattern, 2)), "^:+", ""))
    return lines.where(F.col("line").rlike(pattern)).select("project", "path", "line_no", F.upper(F.regexp_extract("line", pattern, 1)).alias("kind"), text.alias("text"))


def todo_ages(found: DataFrame, blame: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """Markers with their age in days by (project, path, line_no, day) and severity: medium past `days`, else low."""
    rows = found.join(blame, ["project", "path", "line_no"], "left").withColumn("age", F.datediff(today, "day"))
    return rows.drop("day").withColumn("severity", F.when(F.col("age") > days, "medium").otherwise("low"))


def error_gaps(files: DataFrame, found: DataFrame) -> DataFrame:
    """(project, path, line, kind) of bare and silent handlers in Python, empty ones and promises without one in scripts."""
    python = found.where("kind IN ('bare_except', 'except_pass')").select("project", "path", "line", "kind")
    scripts = files.where(S.extension(F.col("path")).isin("js", "ts", "jsx", "tsx", "mjs", "mts", "cjs", "cts"))
    at = F.posexplode(F.split("content", r"(?=\bcatch\s*(\([^)]*\))?\s*\{)")).alias("k", "part")
    before = F.sum(F.length("part") - F.length(F.replace("part", F.lit("\n"), F.lit("")))).over(Window.partitionBy("project", "path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    empty = scripts.select("project", "path", at).withColumn("line", F.coalesce(before, F.lit(0)) + 1).where(F.col("part").rlike(r"^catch\s*(\([^)]*\))?\s*\{\s*((//[^\n]*)\s*)*\}"))
    w = Window.partitionBy("project", "path").orderBy("line_no").rowsBetween(0, 3)
    then = _lines(scripts).withColumn("near", F.array_join(F.collect_list("line").over(w), " ")).where(F.col("line").rlike(r"\.then\s*\(") & ~F.col("near").contains(".catch"))
    return python.union(empty.select("project", "path", "line", F.lit("empty_catch").alias("kind"))).union(then.select("project", "path", "line_no", F.lit("then_no_catch")))


def large_files(files: DataFrame, found: DataFrame, **limits: int) -> DataFrame:
    """(project, path, lines, functions, classes, severity) of files with many non-blank lines."""
    text = F.filter(F.split("content", "\r?\n"), lambda x: S.stripped(x) != "")
    sizes = files.select("project", "path", F.size(text).cast("long").alias("lines")).withColumn("severity", S.size_severity(F.col("lines"), **limits)).where("severity IS NOT NULL")
    defined = found.groupBy("project", "path").agg(F.count_if(F.col("kind").isin("function", "method")).alias("functions"), F.count_if(F.col("kind") == "class").alias("classes"))
    return sizes.join(defined, ["project", "path"], "left").na.fill(0, ["functions", "classes"]).select("project", "path", "lines", "functions", "classes", "severity")


def overengineered(files: DataFrame, found: DataFrame) -> DataFrame:
    """(project, path, line, kind) of single-method classes, tiny files and deep single-file folders."""
    path = F.col("path")
    name = S.basename(path)
    framework = path.rlike(f"/({'|'.join(SINGLE_METHOD_FOLDERS)})/") | name.rlike(f"[.]({'|'.join(SINGLE_METHOD_ROLES)})[.](ts|js)$|-({'|'.join(SINGLE_METHOD_ROLES)})([.][^.]*)?$")
    framework = framework | name.rlike("|".join(e.replace(".", r"\.") + "$" for e in SINGLE_METHOD_ENDINGS))
    plain = ~S.is_test_path(path) & ~S.is_generated(path) & ~framework
    single = found.where(F.col("kind") == "single_method").select("project", "path", "line")
    single = single.union(scripts.single_method(scripts.script_classes(files)).select("project", "path", "line"))
    single = single.where(plain).select("project", "path", "line", F.lit("single_method_class").alias("kind"))
    lines = F.size(F.filter(F.split("content", "\r?\n"), lambda x: S.stripped(x) != ""))
    top = found.where("top AND NOT coalesce(flag, false)").groupBy("project", "path").agg(F.count_if(F.col("kind") == "function").alias("f"), F.count_if(F.col("kind") == "class").alias("c"))
    tiny = files.where(plain & path.endswith(".py") & ~path.endswith("__init__.py")).where(lines.between(1, 14)).join(top.where("f = 1 AND c = 0"), ["project", "path"], "left_semi")
    counts = files.groupBy("project", S.parent(path).alias("folder")).agg(F.count("*").alias("n"))
    deep = counts.where("n = 1 AND size(split(folder, '/')) >= 3")
    above = deep.select("project", "folder", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("folder", "/")) - 1), lambda k: F.array_join(F.slice(F.split("folder", "/"), F.lit(1), k), "/"))).alias("up"))
    full = above.join(counts.where("n > 1").select("project", F.col("folder").alias("up")), ["project", "up"], "left_semi").select("project", "folder").distinct()
    deep = deep.join(full, ["project", "folder"], "left_anti").select("project", F.col("folder").alias("path"), F.lit(0).cast("long"), F.lit("deep_nesting"))
    return single.union(tiny.select("project", "path", F.lit(1).cast("long"), F.lit("tiny_file"))).union(deep)


# ---- frameworks


def framework_findings(files: DataFrame) -> DataFrame:
    """(project, path, rule, severity) of settings, container files and imports."""
    text, path = F.col("content"), F.col("path")
    name = S.basename(path)
    has = lambda pattern: text.rlike(pattern)
    settings = name.rlike("^settings.*[.]py$") | path.rlike("(^|/)settings/[^/]+[.]py$")
    compose, docker = name.rlike("^docker-compose.*[.]ya?ml$") & ~path.contains("/"), name.startswith("Dockerfile")
    loaded = has(r"SECRET_KEY\s*=\s*(config|env|os\.environ|os\.getenv)\s*\(")
    debug = has(r"DEBUG\s*=\s*(config\s*\([^)]*default\s*=\s*True|True)")
    heavy = "|".join(HEAVY_PACKAGES)
    hit = lambda when, rule, severity: F.when(when, F.struct(F.lit(f"framework.{rule}").alias("rule"), F.lit(severity).alias("severity")))
    rules = F.array(
        hit(settings & has(r"""SECRET_KEY\s*=\s*['"](?!%\()""") & ~loaded, "django_secret_key", "critical"),
        hit(settings & loaded & has(r"""default\s*=\s*['"]django-insecure-"""), "django_secret_key", "medium"),
        hit(settings & debug, "django_debug", "high"),
        hit(settings & debug & has(r"SESSION_COOKIE_SECURE\s*=\s*True") & ~has(r"(?i)SESSION_COOKIE_SECURE\s*=.*DEBUG"), "django_cookie_config", "medium"),
        hit(settings & text.contains("rest_framework") & ~F.upper(text).contains("THROTTLE"), "django_no_throttle", "medium"),
        hit(compose & has(r"(?m)^version\s*:"), "docker_version_deprecated", "low"),
        hit(compose & name.contains("prod") & has(r"image:\s*\S+:latest"), "docker_latest_tag", "medium"),
        hit(docker & text.contains("npm install") & ~text.contains("package-lock") & ~has(r"COPY\s+.*lock"), "docker_no_lockfile", "medium"),
        hit(S.extension(path).isin("js", "jsx", "ts", "tsx") & has(rf"""import\s+\*\s+as\s+\w+\s+from\s+['"][^'"]*({heavy})"""), "frontend_wildcard_import", "medium"),
    )
    return files.select("project", "path", F.inline(F.array_compact(rules)))


def heavy_folders(tracked: DataFrame) -> DataFrame:
    """(project, folder, files) of dependency folders among tracked (project, path) rows."""
    folder = F.regexp_extract("path", "^((?:.*?/)?(?:venv|[.]venv|env|node_modules))/", 1)
    return tracked.withColumn("folder", folder).where("folder != ''").groupBy("project", "folder").agg(F.count("*").alias("files"))
