"""Language ID by a linear-chain conditional random field over the words of a text.

A word's evidence for each language is a sum of learned weights of its affixes, inner letter
n-grams and itself (the lexicon); learned transitions tie neighbours, and forward-backward gives
each word's distribution over languages, so texts that switch language are labelled word by word.
A document's language is the one with the largest mean over its words.

Only text enters a prediction.  The weights are fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from kestrel.llm.common import free_name, only, ready

#: Bounds of the fit: labelled documents (twice that at most), bytes of the longest, words taken from each.
FIT_DOCS, FIT_DOC_BYTES, FIT_WORDS = 3000, 1 << 15, 96
#: Words to a training sequence, and the runs of one language that it is spliced from.
SEQUENCE, RUN = 32, 16
BUCKETS, EPOCHS, RATE, DECAY = 1 << 18, 6, 0.3, 1e-6
UNDECIDED = "und"
#: Words to a block of the parallel scan; a batch of words that goes through it at once.
BLOCK, AT_ONCE = 32, 150_000
STRONGEST = 12.0


def _core(word: str) -> bytes:
    """The letters of a word (Unicode's categories L*, so no digits, numerals or marks) in lower case; none if it has no letter."""
    return (word if word.isalpha() else "".join(filter(str.isalpha, word))).lower().encode("utf-8", "replace")


def features(cores: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of each feature of non-empty words: n-grams of 1 to 4 bytes, affixes of 1 to 4, the whole word."""
    sizes = np.fromiter(map(len, cores), np.int64, len(cores))
    rows, buckets = [], []
    mod = np.uint64(BUCKETS - 1)

    def add(which: np.ndarray, value: np.ndarray, salt: int) -> None:
        h = (value + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        rows.append(which)
        buckets.append(((h >> np.uint64(40)) & mod).astype(np.int32))

    # Words of like length together, so that padding stays within a factor of two.
    top = 8
    todo = np.arange(len(cores))
    while len(todo):
        some, todo = todo[sizes[todo] <= top], todo[sizes[todo] > top]
        if len(some):
            n = sizes[some]
            width = top
            joined = np.frombuffer(b"".join(cores[i].ljust(width, b"\0") for i in some.tolist()), np.uint8).reshape(len(some), width).astype(np.uint64)
            for k in range(1, 5):
                if width < k:
                    continue
                grams = np.zeros((len(some), width - k + 1), np.uint64)
                for j in range(k):
                    grams = grams * np.uint64(257) + joined[:, j : width - k + 1 + j] + np.uint64(1)
                inside = np.arange(width - k + 1)[None, :] + k <= n[:, None]
                r, c = np.nonzero(inside)
                add(some[r], grams[r, c], k << 60)
                long = n >= k
                add(some[long], grams[long, 0], (k << 60) + (1 << 56))
                add(some[long], grams[np.flatnonzero(long), (n[long] - k)], (k << 60) + (2 << 56))
            whole = np.zeros(len(some), np.uint64)
            for j in range(width):
                whole = np.where(j < n, whole * np.uint64(1099511628211) + joined[:, j] + np.uint64(1), whole)
            add(some, whole, 9 << 60)
        top *= 2
    return np.concatenate(rows), np.concatenate(buckets)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    start: np.ndarray
    transitions: np.ndarray

    def evidence(self, cores: list[bytes]) -> np.ndarray:
        out = np.zeros((len(cores), len(self.languages)))
        filled = np.array([i for i, c in enumerate(cores) if c], np.int64)
        for at in range(0, len(filled), 20_000):
            part = filled[at : at + 20_000]
            words, buckets = features([cores[i] for i in part.tolist()])
            weights = self.weights[buckets]
            for lang in range(out.shape[1]):
                out[part, lang] = np.bincount(words, weights[:, lang], len(part))
        return out


def marginals(evidence: np.ndarray, lengths: np.ndarray, start: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward over many sequences that lie end to end: each word's distribution over labels.  Evidence is held to STRONGEST below a word's best label, and exact else."""
    forward, backward, _ = _messages(evidence, lengths, start, transitions)
    p = forward * backward
    return p / p.sum(axis=1, keepdims=True)


def _messages(evidence: np.ndarray, lengths: np.ndarray, start: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward, backward, own factor) of each word, each up to a factor of its own.

    Words are cut into blocks, the blocks' products of transition and evidence matrices are chained
    per sequence, then all blocks run forward and backward at once.
    """
    n, labels = evidence.shape
    if not n:
        return evidence.copy(), evidence.copy(), evidence.copy()
    own = np.exp(np.maximum(evidence - evidence.max(axis=1, keepdims=True), -STRONGEST))
    step = np.exp(transitions - transitions.max())
    begin = np.exp(start - start.max())
    lengths = lengths[lengths > 0]
    per_seq = -(-lengths // BLOCK)
    blocks = int(per_seq.sum())
    first_block = np.concatenate([[0], np.cumsum(per_seq)[:-1]])
    seq_start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    seq_of = np.repeat(np.arange(len(lengths)), per_seq)
    nth = np.arange(blocks) - first_block[seq_of]
    at = seq_start[seq_of] + nth * BLOCK
    size = np.minimum(BLOCK, lengths[seq_of] - nth * BLOCK)
    where = at[:, None] + np.arange(BLOCK)[None, :]
    real = np.arange(BLOCK)[None, :] < size[:, None]
    e = np.ones((blocks, BLOCK, labels))
    e[real] = own[where[real]]
    opens = nth == 0  # its first word follows no other

    def chained(m: np.ndarray) -> np.ndarray:
        return (m.reshape(-1, labels) @ step).reshape(-1, labels, labels)

    # A block's matrix takes the vector before its first word to the one after its last.
    whole = np.broadcast_to(np.eye(labels), (blocks, labels, labels)).copy()
    for t in range(BLOCK):
        live = real[:, t]
        if not live.any():
            break
        moved = chained(whole) * e[:, t, None, :]
        if t == 0:
            moved[opens] = np.eye(labels) * e[opens, 0, None, :]
        moved /= moved.max(axis=(1, 2), keepdims=True)
        whole[live] = moved[live]
    ahead = np.empty((blocks, labels))  # before the first word
    behind = np.empty((blocks, labels))  # after the last word
    order = np.argsort(-per_seq, kind="stable")
    most = per_seq[order]
    vector = np.broadcast_to(begin, (len(lengths), labels)).copy()
    for k in range(int(most[0])):
        active = order[: np.searchsorted(-most, -k, "left")]
        b = first_block[active] + k
        ahead[b] = vector[active]
        v = np.einsum("bi,bij->bj", vector[active], whole[b])
        vector[active] = v / v.max(axis=1, keepdims=True)
    vector = np.ones((len(lengths), labels))
    for k in range(int(most[0])):
        active = order[: np.searchsorted(-most, -k, "left")]
        b = first_block[active] + per_seq[active] - 1 - k
        behind[b] = vector[active]
        v = np.einsum("bij,bj->bi", whole[b], vector[active])
        vector[active] = v / v.max(axis=1, keepdims=True)
    forward = np.empty((blocks, BLOCK, labels))
    v = ahead
    for t in range(BLOCK):
        moved = v @ step
        if t == 0:
            moved[opens] = v[opens]
        moved *= e[:, t]
        v = moved / moved.max(axis=1, keepdims=True)
        forward[:, t] = v
    v = behind
    ahead_of, behind_of = np.empty_like(evidence), np.empty_like(evidence)
    ahead_of[where[real]] = forward[real]
    for t in range(BLOCK - 1, -1, -1):
        live = real[:, t]
        behind_of[where[live, t]] = v[live]
        moved = (v * e[:, t]) @ step.T
        moved /= moved.max(axis=1, keepdims=True)
        v = np.where(live[:, None], moved, v)
    return ahead_of, behind_of, own


def fit(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Maximises the conditional likelihood of spliced sequences: runs of words of one document after another, so that transitions are learned too."""
    languages = sorted(set(labels))
    number = {x: i for i, x in enumerate(languages)}
    pick = np.random.default_rng(seed)
    runs: list[tuple[list[bytes], int]] = []
    for text, label in zip(texts, labels, strict=True):
        words = [c for c in map(_core, text.split()) if c]
        if not words:
            continue
        for _ in range(max(1, min(FIT_WORDS, len(words)) // RUN)):
            at = int(pick.integers(0, max(1, len(words) - RUN + 1)))
            runs.append((words[at : at + RUN], number[label]))
    model = Model(languages, np.zeros((BUCKETS, len(languages))), np.zeros(len(languages)), np.zeros((len(languages),) * 2))
    if len(languages) < 2 or not runs:
        return model
    vocabulary: dict[bytes, int] = {}
    coded = [([vocabulary.setdefault(w, len(vocabulary)) for w in words], y) for words, y in runs]
    cores = list(vocabulary)
    f_word, f_bucket = features(cores)
    by_word = np.argsort(f_word, kind="stable")
    f_word, f_bucket = f_word[by_word], f_bucket[by_word]
    sums = [np.full(x.shape, 1e-3) for x in (model.weights, model.start, model.transitions)]
    per_batch, per_seq = 512, max(1, SEQUENCE // RUN)
    for _ in range(EPOCHS):
        order = pick.permutation(len(coded))
        for first in range(0, len(order), per_batch):
            part = [coded[i] for i in order[first : first + per_batch]]
            w = np.concatenate([np.array(x[0]) for x in part])
            y = np.concatenate([np.full(len(x[0]), x[1]) for x in part])
            sizes = [sum(len(x[0]) for x in part[i : i + per_seq]) for i in range(0, len(part), per_seq)]
            used, back = np.unique(w, return_inverse=True)
            lo, hi = np.searchsorted(f_word, used, "left"), np.searchsorted(f_word, used, "right")
            span = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange(int((hi - lo).sum()))
            owner, bucket = np.repeat(np.arange(len(used)), hi - lo), f_bucket[span]
            ev = np.stack([np.bincount(owner, model.weights[bucket, j], len(used)) for j in range(len(languages))], axis=1)[back]
            lengths = np.array(sizes)
            ahead, behind, own = _messages(ev, lengths, model.start, model.transitions)
            p = ahead * behind
            p /= p.sum(axis=1, keepdims=True)
            truth = np.eye(len(languages))[y]
            error = truth - p
            word_error = np.stack([np.bincount(back, error[:, j], len(used)) for j in range(len(languages))], axis=1)
            grad_w = np.stack([np.bincount(bucket, word_error[owner, j], BUCKETS) for j in range(len(languages))], axis=1) / len(part)
            opens = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            grad_s = error[opens].sum(axis=0) / len(part)
            inner = np.ones(len(w), bool)
            inner[opens] = False
            here = np.flatnonzero(inner)
            seen = truth[here - 1].T @ truth[here]
            pair = _pairs(ahead[here - 1], own[here] * behind[here], model.transitions)
            grad_t = (seen - pair) / len(part)
            for x, g, s in zip((model.weights, model.start, model.transitions), (grad_w - DECAY * model.weights, grad_s, grad_t), sums, strict=True):
                s += g * g
                x += RATE * g / np.sqrt(s)
    return model


def _pairs(left: np.ndarray, right: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Sum over neighbours of their joint distribution under the model, from the left one's forward vector and the right one's factor and backward vector."""
    joint = left[:, :, None] * np.exp(transitions - transitions.max()) * right[:, None, :]
    return (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def held_out(id_col: str = "doc_id"):
    """Null ids have no checksum and are held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", docs_bound: int = FIT_DOCS) -> Model | None:
    """Fits on a sample of the labelled rows that are not held out: docs_bound in the mean, twice that at most.  None where there are none."""
    rows = docs.where(~held_out(id_col) & F.col(label_col).isNotNull()).select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"))
    n = rows.select("label").count()
    rows = rows.where("text is not null").where(F.octet_length("text") <= FIT_DOC_BYTES)
    sample = rows.sample(fraction=min(1.0, docs_bound / max(1, n)), seed=11).limit(2 * docs_bound).collect()
    return fit([r.text for r in sample], [r.label for r in sample]) if sample else None


class Words:
    """Remembers each word's evidence: a row of a table that is emptied when it is full."""

    limit = 300_000

    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.table = np.zeros((1024, len(model.languages)))
        self.lettered = np.zeros(1024, bool)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        new = list(set(words).difference(self.rows))
        if len(self.rows) + len(new) > self.limit:
            self.rows.clear()
            new = list(set(words))
        at = len(self.rows)
        need = at + len(new)
        if need > len(self.table):
            grown = max(need, 2 * len(self.table))
            self.table = np.concatenate([self.table, np.zeros((grown - len(self.table), self.table.shape[1]))])
            self.lettered = np.concatenate([self.lettered, np.zeros(grown - len(self.lettered), bool)])
        cores = [_core(w) for w in new]
        if new:
            self.table[at:need] = self.model.evidence(cores)
            self.lettered[at:need] = [bool(c) for c in cores]
            self.rows.update(zip(new, range(at, need), strict=True))
        rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        return self.table[rows], self.lettered[rows]


def label_words(text: str, model: Model) -> list[tuple[str, str, float]]:
    """Each word of a text with its likeliest language and that one's probability; words without letters go with their neighbours."""
    words = text.split()
    if not words:
        return []
    p = marginals(Words(model).of(words)[0], np.array([len(words)]), model.start, model.transitions)
    return [(w, model.languages[int(i)], float(q[i])) for w, q, i in zip(words, p, p.argmax(axis=1), strict=True)]


def _decide(texts: list[str], words: Words, model: Model) -> tuple[list[str], list[float]]:
    split = [t.split() for t in texts]
    lengths = np.array([len(s) for s in split])
    evidence, lettered = words.of([w for s in split for w in s])
    p = marginals(evidence, lengths, model.start, model.transitions)
    owner = np.repeat(np.arange(len(texts)), lengths)
    n = np.bincount(owner, lettered, len(texts))
    means = np.stack([np.bincount(owner, p[:, j] * lettered, len(texts)) for j in range(len(model.languages))], axis=1) / np.maximum(n, 1)[:, None]
    best = means.argmax(axis=1)
    return (
        [model.languages[int(b)] if k else UNDECIDED for b, k in zip(best, n, strict=True)],
        [min(1.0, float(m[b])) if k else 0.0 for m, b, k in zip(means, best, n, strict=True)],
    )


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """The rows with the language of the whole text and its score, from 0 to 1.

    Null and letterless texts, and all texts if nothing could be learned, are `und` with score 0.
    """
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x languages weights, whatever the corpus
    text_at = docs.columns.index(text_col)
    schema = docs.select("*", F.lit("").alias(pred_col), F.lit(0.0).alias(score_col)).schema
    names = schema.names

    def run(batches):
        only("language")
        m = shared.value
        words = Words(m) if m else None
        for batch in batches:
            sizes = pc.binary_length(batch.column(text_at).cast(pa.string())).fill_null(0).to_numpy(zero_copy_only=False)
            first = held = 0
            for i, size in enumerate(sizes.tolist()):
                held += size
                if held >= 6 * AT_ONCE or i == len(sizes) - 1:
                    part = batch.slice(first, i + 1 - first)
                    texts = ["" if t is None else str(t) for t in part.column(text_at).to_pylist()]
                    langs, scores = _decide(texts, words, m) if m else ([UNDECIDED] * len(texts), [0.0] * len(texts))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)
                    first, held = i + 1, 0

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Null, empty and letterless texts are `und` with score 0, and all texts if no row has a label to
    learn from; ties between languages go to the first in alphabetical order.  Repeated rows have a row
    each, rows with a null id are held out, an empty table gives no rows.
    """
    model = train(docs, id_col, text_col, label_col)
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return predict(own, model).drop("text")


def keep_decided(docs: DataFrame, least_score: float = 0.5, **columns: str) -> DataFrame:
    """The documents whose language could be told with at least this score; all columns and the order of rows as they were.

    Null, empty and letterless texts go, and all if no row has a label to learn from; repeated rows
    stay or go alike; an empty table gives an empty one.
    """
    model = train(docs, **columns)
    pred, score = free_name(docs, "lang_pred", "score")
    found = predict(docs, model, columns.get("text_col", "text"), pred, score)
    return found.where((F.col(pred) != UNDECIDED) & (F.col(score) >= least_score)).drop(pred, score)
