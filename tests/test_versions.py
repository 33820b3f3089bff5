"""Versions of keyed state: writers that are lost, damaged files, deltas that equal full runs."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kestrel.operators import versions


@pytest.fixture
def store(spark, tmp_path):
    return versions.Store(spark, f"file://{tmp_path}/s", ["k"], "k long, digest string, n int", 4)


def files(spark, texts):
    return spark.createDataFrame(list(texts.items()), "k long, text string")


def facts(df):
    return df.select("k", F.length("text").alias("n"))


def run(store, texts):
    version, how = versions.evaluate(store, files(store.spark, texts), F.md5("text"), facts)
    assert {r.k: r.n for r in store.read(version).collect()} == {k: len(t) for k, t in texts.items()}
    return how


OLD = {i: "x" * i for i in range(20)}
NEW = {**{i: "x" * i for i in range(3, 20)}, 5: "other", 30: "new"}


def test_delta_equals_full(store):
    assert run(store, OLD) == "full"
    assert run(store, NEW) == "delta"
    assert run(store, NEW) == "same"
    assert run(store, {}) == "delta" and run(store, {1: "a"}) == "delta"


def test_writer_that_is_lost_leaves_the_version_before(store, monkeypatch):
    run(store, OLD)
    before = store.current()

    def lost(texts, step):
        def dies(*a, **k):
            raise RuntimeError("lost")

        with monkeypatch.context() as m:
            m.setattr(versions.json, "dumps", dies) if step == "manifest" else m.setattr(versions.uuid, "uuid4", dies)
            with pytest.raises(RuntimeError):
                run(store, texts)

    for step in ("manifest", "data"):
        lost(NEW, step)
        assert store.current() == before and {r.k for r in store.read(before).collect()} == set(OLD)
    # Files of a writer that was lost between two of them, and a manifest that was never renamed.
    path = Path(store.path.removeprefix("file://"))
    (path / "data" / "half" / "_bucket=1").mkdir(parents=True)
    (path / "manifests" / ".half").write_text("{")
    assert store.current() == before and run(store, NEW) == "delta"


def test_two_writers(store):
    run(store, OLD)
    base, spark = store.current(), store.spark
    rows = spark.createDataFrame([(1, "d", 7)], "k long, digest string, n int")
    store.apply(base, rows, rows.limit(0))
    with pytest.raises(RuntimeError, match="another"):
        store.apply(base, rows, rows.limit(0))
    assert {r.k: r.n for r in store.read(store.current()).collect()}[1] == 7


@pytest.mark.parametrize("damage", ["manifest", "folder", "file"])
def test_damaged_state_means_a_full_run(store, damage):
    run(store, OLD)
    path = Path(store.path.removeprefix("file://"))
    if damage == "manifest":
        (path / "manifests" / "v000000000001.json").write_text('{"0": ["data')
        (path / "manifests" / ".v000000000001.json.crc").unlink(missing_ok=True)
    else:
        bucket = next(iter((path / "data").glob("*/_bucket=*")))
        if damage == "folder":
            shutil.rmtree(bucket)
        else:
            next(bucket.glob("*.parquet")).unlink()
    assert store.current() is None
    assert run(store, NEW) == "full"
    assert run(store, NEW) == "same"
    store.drop_old(1)
    assert run(store, NEW) == "same" and len(list((path / "manifests").glob("v*"))) == 1
