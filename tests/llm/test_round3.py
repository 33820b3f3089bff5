"""The operators for copies, resampling and conversations against brute-force versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import groupby, product

import pytest

from kestrel.llm import conversations, exact_dedup, resampling
from kestrel.llm.queries import EXACT_DEDUP_SQL

TEXTS = [None, "", " ", "One two", "one TWO", "ONE TWO", "Ünï É", "Ünï é", "x" * 300_000, "X" * 300_000, "\x00A", "\x00a", "One two"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, t, i) for i, t in enumerate(TEXTS)] + [(3, "One two", "c", 1), (12, "one two", None, 1), (None, "one two", None, 1), (None, "only null", None, 1), (None, "only null", None, 1)]
    rows += [(100 + i, f"text {i % 700}", None, None) for i in range(3000)] + [(5000 + i, "hot", None, None) for i in range(1500)]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, row_key long").repartition(5)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def wanted(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(lowered(text), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        out += [(i, ids[0], len(ids), n == 0, hashlib.sha256(text.encode()).hexdigest()) for n, i in enumerate(ids)]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_exact_dedup(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(exact_dedup.dedup(docs)) == wanted(rows)
    assert exact_dedup.dedup(docs.limit(0)).count() == 0


def test_exact_dedup_sql(docs):
    import duckdb

    documents = docs.select("doc_id", "text").where("text is null or instr(text, char(0)) = 0").toPandas()
    documents = documents.astype({"doc_id": "Int64"})
    want = sorted((None if r[0] is None else int(r[0]), None if r[1] is None else int(r[1]), *r[2:]) for r in duckdb.sql(EXACT_DEDUP_SQL).fetchall() if r[0] is not None)
    assert want == sorted(r for r in got(exact_dedup.dedup(docs.where("text is null or instr(text, char(0)) = 0"))) if r[0] is not None)


def test_index_takes_and_loses_rows(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    table = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    index = exact_dedup.build(table(rows[::2]), shards=3)
    index = exact_dedup.insert(index, table(rows[1::2]))
    assert got(exact_dedup.groups(index)) == wanted(rows)
    gone = [r for n, r in enumerate(rows) if n % 3 == 0] + [(9999, "never there"), (4, "another text")]
    index = exact_dedup.delete(index, table(gone))
    out = {(i, lowered(t)) for i, t in gone}
    left = [r for r in rows if (r[0], lowered(r[1])) not in out]
    assert got(exact_dedup.groups(index)) == wanted(left)
    # What the filters know is what is stored, up to their false hits.
    for r in index.filters.collect():
        known = exact_dedup.CuckooFilter(slots=bytes(r.slots))
        stored = [bytes(k.digest) for k in index.keys.where(f"shard = {r.shard}").collect()]
        assert all(map(known.has, stored)) and sum(map(bool, known.slots)) == len(stored)
    assert got(exact_dedup.groups(exact_dedup.insert(index, table([])))) == wanted(left)


def test_cuckoo_filter():
    pick = random.Random(5)
    keys = [pick.randbytes(32) for _ in range(3000)]
    filter_ = exact_dedup.CuckooFilter(64)
    put = [k for k in keys if filter_.add(k)]
    assert 220 <= len(put) <= 256 and all(map(filter_.has, put))
    full = filter_.filled(keys)
    assert all(map(full.has, keys)) and full.mask + 1 >= 1024
    assert sum(full.has(pick.randbytes(32)) for _ in range(20_000)) < 20
    for k in keys[::2]:
        assert full.remove(k)
    assert all(map(full.has, keys[1::2])) and sum(map(bool, full.slots)) == 1500


def features(text, orders=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    runs = [" ".join(words[i : i + k]) for k in range(1, orders + 1) for i in range(len(words) - k + 1)]
    return len(words), Counter(zlib.crc32(r.encode()) % 10_000 for r in runs)


def resampled(rows, target):
    read, s, t = [(i, *features(x)) for i, x in rows], Counter(), Counter()
    for _, _, f in read:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    all_s, all_t, out = sum(s.values()), sum(t.values()), []
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    for i, n, f in read:
        weight = sum(gain[b] * c for b, c in f.items()) // sum(f.values()) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    k = 25 * len(able) // 100
    drawn = [(i, f, w, sc, r + 1) for r, (i, n, f, w, sc) in enumerate(able[:k])]
    return sorted(drawn + [(i, f, w, sc, None) for i, n, f, w, sc in able[k:] + [x for x in out if x[1] < 20]], key=repr)


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join(pick.choice(["the", "cat", "Über", "x" * 70, "12", "dog's", "日本"]) + str(int(pick.paretovariate(0.7))) * pick.randint(0, 1) for _ in range(n))


def test_resampling(spark, monkeypatch):
    rows = [(i, prose(i, i % 60)) for i in range(400)] + [(500, None), (501, ""), (None, prose(3, 40)), (None, "a b"), (7, prose(7, 30)), (502, prose(9, 30_000)), (503, "z" * 70_000 + " " + "y" * 100), (504, "the " * 40)]
    rows += [(600 + i, "hot words " * 12) for i in range(300)]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, row_key string, rank int").repartition(4)
    target = [prose(1000 + i, 50) for i in range(20)] + [None]
    wanted_texts = spark.createDataFrame([(t,) for t in target], "text string")
    shape = ["doc_id", "n_features", "weight", "score", "rank"]
    run = lambda d, t: sorted(map(tuple, resampling.resample(d, t).select(shape).collect()), key=repr)
    assert run(table, wanted_texts) == resampled(rows, target)
    assert run(table.where("doc_id < 50"), wanted_texts.limit(0)) == resampled([r for r in rows if r[0] is not None and r[0] < 50], [])
    assert run(table.limit(0), wanted_texts) == []


def test_features_in_pieces(monkeypatch):
    text = prose(4, 3000)
    for orders in (1, 2, 3):
        monkeypatch.setattr(resampling, "PIECE", 300)
        n, found = resampling.Features(orders).counts(text.encode())
        assert (n, {b: c for b, c in enumerate(found.tolist()) if c}) == (lambda x: (x[0], dict(sorted(x[1].items()))))(features(text, orders))


def test_postings_pack():
    import numpy as np

    bucket, doc, count = np.array([0, 0, 3]), np.array([1, 9, 0]), np.array([1, 255, 1 << 40])
    assert [x.tolist() for x in resampling._unpacked(resampling._packed(bucket, doc, count, 5), 5)] == [[0, 0, 3], [1, 9, 0], [1, 255, 1 << 40]]


GRAMMAR = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """rows: (role, text, fault); all edit sequences with at most two inserted rows in a gap are tried."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    choices = [["D"] if f in (1, 2) else ["D", "K", "Ru", "Ra"] for _, _, f in rows]
    for edits in product(*choices):
        cost = sum(4 if e == "D" else 3 * (e[0] == "R") + 3 * (rows[i][2] == 3) for i, e in enumerate(edits))
        if best and cost > best[0]:
            continue
        for fill in product(gaps, repeat=len(rows) + 1):
            total = cost + 3 * sum(map(len, fill))
            if best and total > best[0]:
                continue
            audit, initials, lines = "", "", []
            for i, gap in enumerate(fill):
                audit += "I" * len(gap)
                initials += gap
                lines += [("user:" if g == "u" else "assistant:") for g in gap]
                if i < len(rows):
                    e, (role, text, _) = edits[i], rows[i]
                    audit += e[0]
                    if e != "D":
                        role = role if e == "K" else "user" if e == "Ru" else "assistant"
                        initials += role[:1] or "-"
                        lines.append(f"{role}:{text}")
            if GRAMMAR.fullmatch(initials) and (best is None or (total, audit) < best[:2]):
                best = (total, audit, lines)
    return best


def relaxed(rows):
    """The same by relaxing every edit until nothing gets better, for conversations of any length."""
    step, forced = conversations.STEP, conversations.FORCED
    layer = {0: (0, "", ())}

    def inserts(layer):
        for _ in range(3):
            for q, (c, a, lines) in list(layer.items()):
                to = forced[q]
                new = (c + 3, a + "I", lines + (("user:", "assistant:")[to == 3],))
                if to not in layer or new[:2] < layer[to][:2]:
                    layer[to] = new
        return layer

    layer = inserts(layer)
    for role, text, fault in rows:
        new = {}
        for q, (c, a, lines) in layer.items():
            found = [(q, (c + 4, a + "D", lines))]
            if fault in (0, 3):
                d = c + (3 if fault == 3 else 0)
                if (q, role[:1]) in step:
                    found.append((step[q, role[:1]], (d, a + "K", lines + (f"{role}:{text}",))))
                found.append((forced[q], (d + 3, a + "R", lines + (("user:", "assistant:")[forced[q] == 3] + text,))))
            for to, x in found:
                if to not in new or x[:2] < new[to][:2]:
                    new[to] = x
        layer = inserts(new)
    return min(layer[q] for q in (0, 3) if q in layer)


def damage(rows):
    for conv, turn, role, text in rows:
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        for _ in range(1 + (what == 3)):
            yield conv, turn, "user" if what == 4 else role, text


def mended(table):
    out = []
    left = {c: list(r) for c, r in groupby(sorted(damage(table), key=lambda r: (repr(r[0]), r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())), key=lambda r: r[0])}
    for conv in {r[0] for r in table}:
        rows, seen, faulty = left.get(conv, []), set(), []
        for _, turn, role, text in rows:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 1 if not said else 2 if (role, text) in seen else 3 if said[-1] not in ".!?" else 0
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, lines = relaxed(faulty)
        count = Counter(f for _, _, f in faulty)
        out.append((conv, gaps, count[1], count[2], count[3], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edit_search():
    pick = random.Random(1)
    for n in range(60):
        rows = [(pick.choice(["user", "assistant", "system", "tool", ""]), str(i), pick.choice([0, 0, 0, 1, 2, 3])) for i in range(n % 5)]
        want = cheapest(rows)
        (cost, audit), *rest = conversations.search([r[:1] for r, _, _ in rows], [f for _, _, f in rows]).values()
        assert (cost, audit) == want[:2] == relaxed(rows)[:2] and not rest
        assert conversations.repaired(0, audit, [r for r, _, _ in rows], [t for _, t, _ in rows]) == want[2] == list(relaxed(rows)[2])


def test_chunks_compose():
    pick = random.Random(2)
    for n in range(40):
        rows = [(pick.choice(["user", "assistant", "assistant", "system", "tool"]), str(i), pick.choice([0, 0, 0, 1, 3])) for i in range(n * 2)]
        made, size = conversations.Composer(), pick.randint(1, 6)
        for at in range(0, len(rows), size):
            part = rows[at : at + size]
            made.add({(e, x): found for e in range(4) for x, found in conversations.search([r[:1] for r, _, _ in part], [f for _, _, f in part], e, None).items()})
        cost, steps = made.done()
        assert (cost, "".join(a for _, a in steps)) == relaxed(rows)[:2]


@pytest.mark.parametrize("chunk", [512, 7])
def test_conversations(spark, monkeypatch, chunk):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    pick = random.Random(3)
    texts = ["Hi.", "So?", "no end", "", " \t", "Yes!\u2028", "ok. \x0b", "…", "A.B", None, "Bye."]
    rows = [(c, t, pick.choice(["user", "assistant", "assistant", "system", "tool", None, ""]), pick.choice(texts)) for c in range(300) for t in range(pick.randint(1, 9))]
    rows += [(1000, t, ["user", "assistant"][t % 2] if t % 11 else "system", f"line {t % 500}.") for t in range(3000)] + [(1001, None, "user", f"x{i}.") for i in range(40)]
    rows += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (None, 2, "assistant", "b."), (3, 1, "user", "twice."), (3, 10**12, "user", "far."), (1002, 1, "user", "y" * 100_000 + ".")]
    rows += [(c, 0, "user", "only.") for c in range(2000, 2060)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, conv string").repartition(6)
    got = sorted(map(tuple, conversations.repair(conversations.damaged(table)).collect()), key=repr)
    assert got == mended(rows)
    assert conversations.repair(conversations.damaged(table.limit(0))).count() == 0


def test_join_of_two_long_texts(spark, tmp_path, monkeypatch):
    """Intermediate tables grow with the length of alike texts, not with its square."""
    import os

    from kestrel.llm import jaccard_join

    sizes = {}
    for n in (25_000, 100_000):
        pick = random.Random(n)
        first = [f"w{pick.randrange(10**6)}" for _ in range(n)]
        second = [w if pick.random() > 0.015 else f"v{i}" for i, w in enumerate(first)]
        third = [w if pick.random() > 0.06 else f"u{i}" for i, w in enumerate(first)]
        rows = [(1, " ".join(first)), (2, " ".join(second)), (3, " ".join(third)), (4, "some other text here")]
        monkeypatch.setattr(jaccard_join, "discard", lambda *a: None)
        folder = f"file://{tmp_path}/{n}"
        got = jaccard_join.grouped(spark.createDataFrame(rows, "doc_id long, text string"), folder=folder)
        assert {r.doc_id: r.component_id for r in got.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
        sizes[n] = sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(f"{tmp_path}/{n}") for f in files)
    assert sizes[100_000] < 6 * sizes[25_000] and sizes[100_000] < 60 << 20
