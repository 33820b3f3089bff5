"""Data sources of trees and logs: what is listed, what is read, and streams that go on."""

import os

import pytest

from kestrel.sources import datasource, files


@pytest.fixture
def tree(spark, tmp_path):
    datasource.register(spark)
    for path, text in {
        "a/x.py": "one", "a/src/deep/y.py": "two", "a/.hidden": "", "a/node_modules/z.js": "no", "b/x.py": "three", "top.md": "four",
        "a/.gitignore": "*.log\n/build/\n!keep.log\n# remark\n\n", "a/one.log": "", "a/keep.log": "", "a/build/out.py": "", "a/src/build/in.py": "",
        "a/src/.gitignore": "!two.log\ndeep/*.tmp\n**/gone.py\n", "a/src/two.log": "", "a/src/deep/c.tmp": "", "a/src/deep/more/c.tmp": "", "a/src/q/r/gone.py": "", "b/one.log": "",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return tmp_path


def test_tree(spark, tree):
    df = spark.read.format("kestrel_tree").option("root", str(tree)).load()
    rows = {r.path: (r.project, r.content) for r in df.collect()}
    assert rows["a/x.py"] == ("a", "one") and rows["top.md"] == (None, "four") and rows["a/.hidden"] == ("a", "")
    assert "a/node_modules/z.js" not in rows and len(rows) == 14
    every = spark.read.format("kestrel_tree").option("root", str(tree)).option("skip", "false").load()
    assert every.count() == 17


def test_filters_reach_the_listing(spark, tree):
    """A folder that is not to be read is one that can't be read."""
    load = lambda: spark.read.format("kestrel_tree").option("root", str(tree)).load()
    (tree / "b" / "x.py").unlink()
    os.symlink("/nowhere", tree / "b" / "x.py")
    paths = lambda df: sorted(r.path for r in df.select("path").collect())
    assert paths(load().where("path = 'a/x.py'")) == ["a/x.py"]
    assert paths(load().where("path in ('a/x.py', 'top.md', 'none')")) == ["a/x.py", "top.md"]
    assert paths(load().where("project = 'a' and path like 'a/src/deep/%'")) == ["a/src/deep/c.tmp", "a/src/deep/more/c.tmp", "a/src/deep/y.py"]
    assert paths(load().where("path in ('a/node_modules/z.js', '../x')")) == paths(load().where("path like 'a/node_modules/%'")) == []
    listed = []
    reader = datasource.TreeReader(str(tree), True)
    original = reader._list
    reader._list = lambda store, base, folder: listed.append(folder) or original(store, base, folder)
    from pyspark.sql.datasource import StringStartsWith

    assert len(list(reader.pushFilters([StringStartsWith(("path",), "a/src/d")]))) == 1
    found = [i.path for p in reader.partitions() for i in reader._files(*datasource._store(str(tree)), p)]
    assert {os.path.relpath(p, tree) for p in found} == {"a/src/deep/c.tmp", "a/src/deep/more/c.tmp", "a/src/deep/y.py"}
    assert all(f == "a/src" or f.startswith("a/src/deep") for f in listed)


def test_nested_ignore_rules(spark, tree):
    df = spark.read.format("kestrel_tree").option("root", str(tree)).option("skip", "false").load()
    kept = {r.path for r in files.without_ignored(df).select("path").collect()}
    assert kept == {"a/x.py", "a/src/deep/y.py", "a/.hidden", "a/node_modules/z.js", "b/x.py", "top.md", "a/.gitignore", "a/keep.log", "a/src/build/in.py", "a/src/.gitignore", "a/src/two.log", "a/src/deep/more/c.tmp", "b/one.log"}


def test_lines_of_logs_that_grow(spark, tmp_path):
    datasource.register(spark)
    logs, seen = tmp_path / "logs", []
    logs.mkdir()
    (logs / "a.jsonl").write_bytes(b'{"n": 1}\n{"n": 2}\r\n{"n": 3')
    (logs / "b.txt").write_text("not this\n")

    def run():
        df = spark.readStream.format("kestrel_lines").option("folder", str(logs)).load()
        query = df.writeStream.foreachBatch(lambda batch, n: seen.extend(tuple(r) for r in batch.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        got, seen[:] = sorted(seen), []
        return got

    assert run() == [("a.jsonl", 0, '{"n": 1}'), ("a.jsonl", 9, '{"n": 2}')]
    with (logs / "a.jsonl").open("ab") as f:
        f.write(b"0}\nlast")
    (logs / "c.jsonl").write_text("é\n\n" + "x" * 200_000)
    assert run() == [("a.jsonl", 19, '{"n": 30}'), ("c.jsonl", 0, "é"), ("c.jsonl", 3, "")]
    assert run() == []
