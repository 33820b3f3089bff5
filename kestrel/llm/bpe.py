"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a piece of bytes exactly one vocabulary entry can be the last token of the
prefix's encoding.  An automaton over the vocabulary gives, at each position, the entries that are
suffixes of the prefix; the entry whose neighbour to the left is compatible is stored, and
back-pointers from the end give the ids.  Two tokens are compatible if byte-pair merging of their
joined bytes leaves the border between them: no pair along the border (right edge of the left
token's merge tree, left edge of the right one's) merges while both its sides are alive.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kestrel.llm.common import ready, text_or_empty

#: White space as Unicode defines it (Python's own \s also takes U+001C to U+001F).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
FOREVER = 1 << 40


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: Latin-1's visible characters stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _check(spec: dict, path: str) -> None:
    """Raises an error for a file that asks for what is not done here: then ids would be wrong."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    wrong = [
        what
        for what, bad in (
            ("a normalizer", spec.get("normalizer")),
            ("another pre-tokenizer than ByteLevel with its pattern and without a space in front", pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)),
            ("another model than BPE", model.get("type", "BPE") != "BPE"),
            ("dropout, byte fallback, whole words before merges, prefixes or suffixes", any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))),
            ("added tokens that take white space, match single words or normalized text", any(a.get(k) for a in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))),
        )
        if bad
    ]
    if wrong:
        raise ValueError(f"{path} has {'; '.join(wrong)}")


class PrefixBPE:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    cache_limit = 600_000
    pair_limit = 2_000_000

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec, path)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.bytes_of = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.token_bytes = self.bytes_of | {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((left, right), rank)
            parts.setdefault(whole, (left, right, rank))
        self.right_edge = {t: self._edge(t, 1, parts) for t in vocab.values()}
        self.left_edge = {t: self._edge(t, 0, parts) for t in vocab.values()}
        self.automaton = ahocorasick.Automaton()
        for t, b in self.bytes_of.items():
            if len(b) == 1 or t in parts:
                self.automaton.add_word(b.decode("latin-1"), (t, len(b)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.pieces = regex.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{SPACE}\\p{{L}}\\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
        )
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        encoder = self

        class Cache(dict):
            def __missing__(self, key):
                return encoder._remember(self, key)

        self.by_chunk, self.by_piece = Cache(), {}

    @staticmethod
    def _edge(token: int, side: int, parts: dict) -> list[tuple[int, int]]:
        """(token, rank of the merge that ends it) along one edge of the merge tree, outermost first."""
        out, dies = [], FOREVER
        while True:
            out.append((token, dies))
            if token not in parts:
                return out
            dies = parts[token][2]
            token = parts[token][side]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            known = True
            for u, u_dies in self.right_edge[left]:
                for v, v_dies in self.left_edge[right]:
                    r = self.rank.get((u, v))
                    if r is not None and r < u_dies and r <= v_dies:
                        known = False
            if len(self.pairs) >= self.pair_limit:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        pairs, compatible = self.pairs, self.compatible
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            before = end - length
            if before:
                ok = pairs.get(last[before] << 32 | token)
                if ok is None:
                    ok = compatible(last[before], token)
                if not ok:
                    continue
            last[end], size[end] = token, length
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        out.reverse()
        return out

    def _remember(self, cache: dict, chunk: str) -> bytes:
        out, known = [], self.by_piece
        for piece in self.pieces.findall(chunk):
            ids = known.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode())
                if len(piece) <= 64:
                    if len(known) >= self.cache_limit:
                        known.clear()
                    known[piece] = ids
            out += ids
        packed = np.array(out, "<u4").tobytes()
        if len(chunk) <= 64:
            if len(cache) >= self.cache_limit:
                cache.clear()
            cache[chunk] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not self.cut.search(text):
            return b"".join(map(self.by_chunk.__getitem__, CHUNK.findall(text)))
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += map(self.by_chunk.__getitem__, CHUNK.findall(text[at : m.start()]))
            out.append(np.array([self.special[m[0]]], "<u4").tobytes())
            at = m.end()
        return b"".join([*out, *map(self.by_chunk.__getitem__, CHUNK.findall(text[at:]))])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixBPE:
    return PrefixBPE(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: id, token count and digests of the ids and of the text decoded from them; with_ids adds the packed ids.

    Null text counts as empty: no tokens.  Repeated rows give repeated results, other columns are
    left aside, an empty table gives an empty result; the id may be null.
    """
    ready(docs.sparkSession)

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            counts, ids_sha, text_sha, packed = [], [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py())
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                if with_ids:
                    packed.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(packed, pa.binary())] if with_ids else []), names)

    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
