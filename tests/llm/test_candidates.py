"""Candidate pairs of the Jaccard join: texts that share much, but not enough, are few of them."""

import random

from kestrel.llm import jaccard_join


def _shingles(text, k=5):
    words = text.split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def test_alike_texts_below_the_threshold_make_few_pairs(spark, monkeypatch):
    r = random.Random(7)
    words = lambda n, mark: [f"{mark}{r.randrange(1 << 40):x}" for _ in range(n)]
    common = words(219, "c")
    texts = [" ".join(common + words(45, f"w{i}x")) for i in range(100)]
    # Copies of a few with one word changed: these link.
    texts += [t.replace(t.split()[100 + i], "changed", 1) for i, t in enumerate(texts[:6])]
    made = {}

    def stash(df, folder, name, *codec, old=jaccard_join.stash):
        out = old(df, folder, name, *codec)
        if name == "pairs":
            made[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "stash", stash)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x.doc_id: x.component_id for x in jaccard_join.join(docs, words=5, hundredths=80).collect()}
    sets, want = [_shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for k, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 80 * len(a | b) and want[i] != want[k]:
                least, most = sorted((want[i], want[k]))
                want = [least if x == most else x for x in want]
    assert found == dict(enumerate(want))
    assert len(set(want)) == 100
    # The groups' bounds alone allowed thousands.
    assert made["pairs"] < 100
