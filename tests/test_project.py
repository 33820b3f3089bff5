from kestrel.operators import code, interface, project

VIEW = """import { useEffect, useState } from 'react'
// <button>not code</button>
export function Panel({ a }) {
  const [n, setN] = useState(0)
  setN(1)
  if (a) { setN(2) }
  useEffect(() => { setN(3); f(a, b) })
  React.useEffect(() => { f() }, [])
  const on = () => setN(4)
  return (
    <form>
      <p>Don't <b>panic</b></p>
      <button type="submit">ok</button>
      <button type="button">bad</button>
      <button onClick={save()}>called</button>
      <button onClick={() => save()}>fine</button>
      <button {...rest} />
      <div onClick={on}><button>bubbles</button></div>
      <button onClick={async () => { await go() }}>loose</button>
      <button onClick={async () => { try { await go() } catch (e) { log(e) } }}>held</button>
      <Card className="x" /><x-tag />
    </form>
  )
}
"""


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(spark, data):
    return spark.createDataFrame(data, "project string, path string, content string")


def test_interface_rules(spark):
    found = interface.findings(files(spark, [("p", "a.jsx", VIEW), ("p", "b.py", VIEW), ("p", "c.tsx", None)])).where("rule LIKE 'ux.%'")
    assert rows(found.select("line", "rule")) == sorted(
        [
            (5, "ux.setstate-in-render"),
            (6, "ux.setstate-in-render"),
            (7, "ux.effect-missing-deps-array"),
            (14, "ux.button-no-handler"),
            (15, "ux.handler-called-not-referenced"),
            (19, "ux.async-handler-no-catch"),
        ],
        key=repr,
    )


def test_broken_scripts_end(spark):
    bad = ["<", "<a", "<a b={", "useEffect(", "function A({", "const A = (", '"', "`", "<a b=", "<a b={{}}>{<c"]
    interface.findings(files(spark, [("p", f"{i}.tsx", t) for i, t in enumerate(bad)])).collect()


def test_reuse_counts_files(spark):
    page = "const A = () => <div className='card'><my-tag/><i/></div>"
    data = [("p", f"{n}.tsx", page) for n in "abc"] + [("q", "a.tsx", page)]
    assert rows(interface.reuse(interface.findings(files(spark, data)))) == [("p", "<div class='card'>", 3, 3), ("p", "<my-tag>", 3, 3)]


def test_readme_ignore_and_tests(spark):
    data = [
        ("a", "README.md", "Install it, then run it. " + "word " * 20),
        ("a", ".gitignore", "__pycache__/\n.venv\n*.pyc\n.DS_Store\n.env"),
        ("a", "x.py", ""),
        ("a", ".env", "A=1"),
        ("a", "tests/test_x.py", ""),
        ("a", "pyproject.toml", ""),
        ("b", "docs/README.md", "install run"),
        ("b", "package.json", "{}"),
        ("b", "lib/.gitignore", "x"),
        ("b", "node_modules/y/a.test.js", ""),
        ("c", "readme", "short"),
    ]
    df = files(spark, data)
    assert rows(project.readmes(df)) == [("a", "info", []), ("b", "medium", ["readme"]), ("c", "low", ["install", "run", "description"])]
    assert rows(project.ignore_gaps(df)) == [("b", "low", ["node_modules", ".DS_Store"]), ("c", "medium", [".gitignore"])]
    assert rows(project.tests(df)) == [("a", 1, "pytest", "info"), ("b", 0, "unknown", "high"), ("c", 0, "unknown", "high")]


def test_styles(spark):
    text = "x = 1\nw.setStyleSheet(f\"color: purple; padding: 2px\")\nS = \"margin: -4px; color: red\"\n"
    found = project.styles(files(spark, [("p", "a.py", text), ("p", "venv/a.py", text), ("p", "n.py", None)]))
    assert rows(found.select("line", "rule")) == [(2, "cramped-padding"), (2, "purple-gradient"), (3, "negative-margin")]


def test_missing_types(spark):
    text = "def a(x, *, y: int = 1): pass\ndef b(x: int) -> int: pass\nclass C:\n    def m(self): pass\n    def test_m(self, x): pass\n@app.get('/')\ndef d(x): pass\n"
    found = project.missing_types(code.facts(files(spark, [("p", "a.py", text), ("p", "tests/b.py", text)])))
    assert rows(found) == [("p", "a.py", 1, "a", 1, True)]


def test_unfinished(spark):
    df = spark.createDataFrame([("r", "staged", "a"), ("r", "modified", "a")] + [("s", "untracked", str(i)) for i in range(6)], "repo string, bucket string, path string")
    assert rows(project.unfinished(df)) == [("r", 1, "info"), ("s", 6, "medium")]
