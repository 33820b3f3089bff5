import pytest

from kestrel.operators import code

FILES = [
    ("p", "api.py", "from core.models import Order\nimport json\nimport re  # noqa: F401\nimport os  # noqa: E501\ndef go(x):\n    try:\n        return Order\n    except:\n        pass\n# TODO: mend this\nsleep(20)\nu = 'http://evil.test/x'\n"),
    ("p", "core/__init__.py", "from .late import far as _far\n"),
    ("p", "core/late.py", "def far(): pass\n"),
    ("p", "core/models.py", "class Order:\n    def __init__(self): pass\n    def run(self): return helper\nclass Unused: pass\n"),
    ("p", "core/b.py", "from .models import Order\nfrom typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    from core import late\nx = Order\n"),
    ("p", "web/a.ts", "import x from './b'\n// import q from './c'\nimport y from '@/z'\nx()\ntry { a() } catch (e) { }\nfetch(u).then(f)\n  .catch(g)\n"),
    ("p", "web/b.tsx", "export const q = 1"),
    ("p", "web/c.ts", ""),
    ("p", "src/z/index.ts", None),
    ("p", "bad.py", "def (:\nimport os\n"),
    ("p", "settings.py", "DEBUG = True\nSECRET_KEY = 'abc'\n"),
    ("p", "c.py", "# a = 1\n# b = 2\n# c = f(a, b)\n# if c:\n#     d = 3\nx = 1\n\n# some words\n# that say\n# what this\n# file is\n# good for\n"),
    ("q", "packages/one/lib/util.py", "def far(): pass\n"),
    ("q", "main.py", "import lib.util\n"),
]


@pytest.fixture(scope="module")
def tree(spark):
    files = spark.createDataFrame(FILES, "project string, path string, content string").cache()
    return files, code.facts(files).cache()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_unused_imports(tree):
    assert rows(code.unused_imports(*tree)) == [("p", "api.py", 2, "json"), ("p", "api.py", 4, "os"), ("p", "bad.py", 2, "os"), ("q", "main.py", 1, "lib")]


def test_unused_definitions_know_reexports(tree):
    names = [(r.project, r.path, r.name) for r in code.unused_definitions(tree[1]).orderBy("project", "path", "name").collect()]
    assert names == [("p", "api.py", "go"), ("p", "core/models.py", "Unused"), ("p", "core/models.py", "run"), ("q", "packages/one/lib/util.py", "far")]


def test_python_modules_resolve(tree):
    assert rows(code.resolve_python(*tree).select("project", "src", "dst")) == [
        ("p", "api.py", "core/models.py"),
        ("p", "core/__init__.py", "core/late.py"),
        ("p", "core/b.py", "core/late.py"),
        ("p", "core/b.py", "core/models.py"),
        ("q", "main.py", "packages/one/lib/util.py"),
    ]


def test_script_modules_resolve(tree):
    assert rows(code.resolve_js(tree[0])) == [("p", "web/a.ts", "src/z/index.ts"), ("p", "web/a.ts", "web/b.tsx")]


def test_orphans(tree):
    edges = code.resolve_python(*tree).select("project", "src", "dst").union(code.resolve_js(tree[0]))
    assert {r.path for r in code.orphans(tree[0], edges).collect()} == {"api.py", "core/b.py", "web/a.ts", "web/c.ts", "bad.py", "c.py"}


def test_debt(tree):
    assert rows(code.hardcoded(tree[0])) == [("p", "api.py", 11, "sleep", "20"), ("p", "api.py", 12, "url", "http://evil.test/x")]
    assert rows(code.todos(tree[0])) == [("p", "api.py", 10, "TODO", "mend this")]
    assert rows(code.error_gaps(*tree)) == [("p", "api.py", 8, "bare_except"), ("p", "api.py", 8, "except_pass"), ("p", "web/a.ts", 5, "empty_catch")]
    assert rows(code.commented_code(tree[0])) == [("p", "c.py", 1, 5)]
    assert ("p", "core/models.py", 1, "single_method_class") in rows(code.overengineered(*tree))


def test_settings_and_entry_points(tree):
    assert {(r.path, r.rule, r.severity) for r in code.framework_findings(tree[0]).collect()} == {("settings.py", "framework.django_secret_key", "critical"), ("settings.py", "framework.django_debug", "high")}
    assert {(r.path, r.kind) for r in code.entry_points(tree[0]).collect()} == {("src/z/index.ts", "js_entry"), ("main.py", "python_main")}


def test_deep_folders(spark):
    files = spark.createDataFrame([("p", f"{d}/x.txt", "") for d in ("a", "a/b", "a/b/c", "d", "d/e/f")] + [("p", "d/y.txt", "")], "project string, path string, content string")
    found = code.overengineered(files, code.facts(files))
    assert [r.path for r in found.collect()] == ["a/b/c"]


def test_no_files(spark):
    files = spark.createDataFrame([], "project string, path string, content string")
    found = code.facts(files)
    for df in (code.unused_imports(files, found), code.unused_definitions(found), code.resolve_python(files, found), code.resolve_js(files), code.error_gaps(files, found), code.todos(files)):
        assert df.count() == 0
