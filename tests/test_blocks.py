"""Whole duplicate blocks against all repeats of a small set of files."""

import random
from collections import defaultdict

from kestrel.operators import blocks, text


def brute(files, size):
    """(blocks, places) from every run of lines of every file."""
    runs = defaultdict(list)
    for f, lines in files.items():
        for i in range(len(lines)):
            for j in range(i + size, len(lines) + 1):
                runs[tuple(lines[i:j])].append((f, i))
    kept = {}
    for run, at in runs.items():
        after = [files[f][i + len(run)] if i + len(run) < len(files[f]) else (f, i) for f, i in at]
        before = [files[f][i - 1] if i else (f, i) for f, i in at]
        if len({f for f, _ in at}) > 1 and len(set(after)) > 1 and len(set(before)) > 1:
            kept[run] = sorted(at)
    name = lambda run: (*kept[run][0], len(run))
    longest = lambda f, i, most: max((r for r in kept if (f, i) in kept[r] and len(r) < most), key=len, default=None)
    found = set()
    for run in kept:
        shorter = longest(*kept[run][0], len(run))
        found.add((*name(run), len(kept[run]), *(name(shorter) if shorter else (None, None, None))))
    places = {(*name(r), f, i) for f, lines in files.items() for i in range(len(lines)) if (r := longest(f, i, 10**9))}
    return found, places


def check(spark, files, size=3):
    table = spark.createDataFrame([(f, "\n".join(lines)) for f, lines in files.items()], "doc_id string, text string")
    found, places = blocks.whole_blocks(text.windows(table, size), size)
    less = lambda n: None if n is None else n - 1
    got = {(r.first, r.first_seq - 1, r.length, r.places, r.shorter_first, less(r.shorter_seq), r.shorter_length) for r in found.collect()}
    own = {(r["first"], r.first_seq - 1, r.length, r.doc_id, r.seq - 1) for r in places.collect()}
    want = brute(files, size)
    assert (got, own) == want
    return got


def test_partial_overlap_of_three_files(spark):
    lines = [f"line number {i}" for i in range(1, 31)]
    got = check(spark, {"A": lines[:10], "B": lines, "C": lines, "D": ["other one", *lines[4:9], "other two"], "E": ["alone"] * 2})
    assert ("B", 0, 30, 2, "A", 0, 10) in got and ("A", 0, 10, 3, None, None, None) in got


def test_repeats_within_files(spark):
    pick = random.Random(3)
    files = {f"f{n}": [f"row {pick.choice('abc')}" for _ in range(pick.randint(0, 25))] for n in range(8)}
    files |= {"p": ["same line"] * 9, "q": ["same line"] * 12, "r": [f"only {i}" for i in range(9)] * 2}
    check(spark, files)


def test_no_repeats(spark):
    check(spark, {"A": ["one line", "two lines"], "B": [f"row {i}" for i in range(9)], "C": []})
