"""Token-id files: one zstandard frame per document under a dictionary shared by all files.

File layout (all integers little-endian):

    magic "KTOKIDS1" | width of an id in bytes, u32 | SHA-256 of the dictionary, 32 bytes
    frames, one per document, in ascending doc_id order
    index: per document doc_id i64, has_id u64 (0: null), offset u64, frame bytes u64, n_tokens u64
    n_documents u64 | offset of the index u64 | magic "KTOKIDSX"

A short document is read with one seek to its frame.  The dictionary lies beside the files as
``dictionary-<sha256>.zdict``; a reader refuses files written under another one.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kestrel.llm.common import only, open_fs, partitions, ready, shared_dir, stash, text_or_empty
from kestrel.llm.words import Words, ragged, together

MAGIC, END_MAGIC = b"KTOKIDS1", b"KTOKIDSX"
HEAD, INDEX_ROW, TAIL = struct.Struct("<8sI32s"), np.dtype([("doc_id", "<i8"), ("has_id", "<u8"), ("offset", "<u8"), ("size", "<u8"), ("n", "<u8")]), struct.Struct("<QQ8s")
#: Documents that the dictionary is trained on at most, and the longest of them in bytes of text.
DICTIONARY_DOCS, DICTIONARY_DOC_BYTES, DICTIONARY_BYTES = 512, 1 << 16, 1 << 16
READ_BLOCK = 1 << 22


class WordEncoder:
    """Whole texts through the tokenizers library, one call per distinct word.

    Only for vocabularies whose tokens never span white space and that drop it: then the ids of a
    text are those of its words.  Others are encoded text by text.  The words of a part of a batch
    are told apart by 64-bit hashes, known ones are found by their bytes.
    """

    #: Words and ids that are remembered; beyond that all are forgotten.
    limit, ids_limit, longest = 700_000, 1 << 24, 64
    #: Bytes of text whose words are told apart at once.
    part = 1 << 21

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self._forget()
        probe = ["a b", "a \n\tb", "ab  c. d"]
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.by_words = all(ids(p) == [i for w in p.split() for i in ids(w)] for p in probe)
        plain = [t for t in self.tokenizer.get_added_tokens_decoder().items() if t[1].special and not (t[1].lstrip or t[1].rstrip or t[1].single_word or t[1].normalized)]
        self.border = next(((i, t.content) for i, t in plain if ids(f"a{t.content}b") == [*ids("a"), i, *ids("b")]), None)
        # Words are remembered here; the library's own cache would only be filled and emptied.
        getattr(self.tokenizer.model, "_resize_cache", lambda _: None)(0)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)]) if suffix else None

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def _apart(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(ids of the words in pieces, sizes of the words in pieces), a special token between any two in one text: it splits text before all else."""
        if self.border is None or any(self.border[1] in w for w in words):
            every = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return every, [np.fromiter(map(len, every), np.int64, len(every))]
        border, mark = self.border
        ids, sizes = [], []
        for e in self.tokenizer.encode_batch_fast([mark.join(words[i : i + 200]) for i in range(0, len(words), 200)], add_special_tokens=False):
            own = np.array(e.ids, self.dtype)
            at = own == border
            sizes.append(np.diff(np.concatenate([[-1], np.flatnonzero(at), [len(own)]])) - 1)
            ids.append(own[~at])
        return ids, sizes

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """Numbers of new words.

        Where each word of letters is one piece for the vocabulary, its last id says so, and blanks
        are enough between them; the others go apart.
        """
        texts = [w.decode() for w in words]
        letters = np.array([self.closes is not None and t.isalpha() for t in texts], bool)
        plain, rest = np.flatnonzero(letters).tolist(), [np.flatnonzero(~letters)]
        parts = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        order, ids, sizes = [], [], []
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in part]) for part in parts], add_special_tokens=False), strict=True):
            own = np.array(e.ids, self.dtype)
            stops = np.flatnonzero(self.closes[own]) + 1
            if len(stops) == len(part) and stops[-1] == len(own):  # no word gives fewer than one
                order.append(np.array(part))
                ids.append(own)
                sizes.append(np.diff(stops, prepend=0))
            else:
                rest.append(np.array(part))
        if len(rest := np.concatenate(rest)):
            more_ids, more_sizes = self._apart([texts[i] for i in rest.tolist()])
            order, ids, sizes = [*order, rest], ids + more_ids, sizes + more_sizes
        sizes, first, numbers = np.concatenate(sizes), len(self.sizes), np.empty(len(words), np.int64)
        numbers[np.concatenate(order)] = np.arange(first, first + len(words))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, *ids])
        self.known.update((w, n) for w, n in zip(words, numbers.tolist(), strict=True) if len(w) <= self.longest)
        return numbers

    def _numbers(self, found: Words) -> np.ndarray:
        """For each word of a part the number that its ids are kept under."""
        if len(self.known) > self.limit or len(self.ids) > self.ids_limit:
            self._forget()
        _, first, back = np.unique(found.hashes, return_index=True, return_inverse=True)
        data = found.data.tobytes()
        words = [data[a:b] for a, b in zip(found.starts[first].tolist(), found.ends[first].tolist(), strict=True)]
        numbers = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(numbers < 0)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            numbers[part] = self._learn([words[i] for i in part.tolist()])
        return numbers[back]

    def encode(self, texts: pa.Array):
        """(first row, ids of the texts one after another, bounds between texts) of parts of an array of strings."""
        for first, part in together(texts, self.part):
            if self.by_words:
                found = Words(part, lower=False)
                numbers = self._numbers(found)
                sizes = self.sizes[numbers]
                stops = np.concatenate([[0], np.cumsum(sizes)])[found.bounds]
                yield first, self.ids[ragged(self.starts[numbers], sizes)], stops
            else:
                ids = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.dtype) for t in part.to_pylist()]
                yield first, np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        if not self.by_words:
            return np.concatenate([np.diff(stops) for _, _, stops in self.encode(texts)] or [np.zeros(0, np.int64)])
        out = [np.zeros(0, np.int64)]
        for _, part in together(texts, self.part):
            found = Words(part, lower=False)
            numbers = self._numbers(found)
            out.append(np.diff(np.concatenate([[0], np.cumsum(self.sizes[numbers])])[found.bounds]))
        return np.concatenate(out)

    def packed(self, texts: pa.Array, end: int | None) -> list[bytes]:
        """The ids of each text, and the end id, as bytes."""
        tail = b"" if end is None else np.array([end], self.dtype).tobytes()
        return [ids[a:b].tobytes() + tail for _, ids, stops in self.encode(texts) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]


def word_encoder(path: str) -> WordEncoder:
    return only(("words", path), lambda: WordEncoder(path))


def _encoded(docs: DataFrame, path: str, text_col: str, ids_col: str | None, count_col: str) -> DataFrame:
    ready(docs.sparkSession)
    new = [c for c in (count_col, ids_col) if c]
    keep = [c for c in docs.columns if c.lower() not in {x.lower() for x in (text_col, *new)}]
    own = [F.col(f"`{c}`") for c in keep]
    source = docs.select(*own, text_or_empty(F.col(f"`{text_col}`")).alias(text_col))
    schema = source.select(*own, F.lit(None).cast("long").alias(count_col), *([F.lit(None).cast("binary").alias(ids_col)] if ids_col else [])).schema

    def run(batches):
        encoder = word_encoder(path)
        for batch in batches:
            texts = batch.column(len(keep))
            if not ids_col:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(encoder.counts(texts), pa.int64())], schema.names)
                continue
            for first, ids, stops in encoder.encode(texts):
                packed = [ids[a:b].tobytes() for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(packed)) for c in batch.columns[:-1]), pa.array(np.diff(stops), pa.int64()), pa.array(packed, pa.binary())], schema.names)

    return source.mapInArrow(run, schema)


def with_counts(docs: DataFrame, path: str, text_col: str = "text", count_col: str = "n_tokens") -> DataFrame:
    """The rows without their text, with the number of token ids of it; null text has none.  A column of that name is replaced."""
    return _encoded(docs, path, text_col, None, count_col)


def with_ids(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens") -> DataFrame:
    """The rows without their text, with its number of token ids and the ids (little-endian, two bytes each for vocabularies of up to 2^16, else four); null text has none.  Columns of those names are replaced."""
    return _encoded(docs, path, text_col, ids_col, count_col)


def _put(uri: str, data: bytes) -> None:
    fs, path = open_fs(uri)
    with fs.open_output_stream(path) as f:
        f.write(data)


def _dictionary(docs: DataFrame, path: str, end: int | None) -> bytes:
    """Trained on a bounded sample of the documents that are not too long: DICTIONARY_DOCS of them in the mean, twice that at most."""
    import zstandard

    n = docs.count()
    short = docs.where(F.octet_length("text") <= DICTIONARY_DOC_BYTES)
    rows = short.sample(fraction=min(1.0, DICTIONARY_DOCS / max(1, n)), seed=17).limit(2 * DICTIONARY_DOCS).select("text").collect()
    samples = [x for x in word_encoder(path).packed(pa.array([r[0] for r in rows], pa.string()), end) if x]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to train on: the ids themselves serve as content
        return b"".join(samples)[:DICTIONARY_BYTES]


def write(docs: DataFrame, path: str, end: int | None = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encodes every whole text with the vocabulary file at path and writes the id files; returns their manifest.

    Null text counts as empty (a document of the end id alone).  Documents lie in ascending id, null
    ids first, repeated ids by content.  Rows of the manifest are in file order: file, path,
    dictionary, n_docs, n_tokens, start (ids in earlier files).  An empty table gives no files.
    """
    spark = docs.sparkSession
    ready(spark)
    folder = folder or shared_dir(spark, "token-ids")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    content, width = _dictionary(docs, path, end), word_encoder(path).width
    sha = hashlib.sha256(content).digest()
    open_fs(folder)[0].create_dir(open_fs(folder)[1], recursive=True)
    _put(f"{folder}/dictionary-{sha.hex()}.zdict", content)

    # Files are ranges of ids of about as many documents; the bounds come from the id column alone.
    n_files = 4 * partitions(spark)
    bounds = sorted({int(x) for x in docs.select("doc_id").approxQuantile("doc_id", [i / n_files for i in range(1, n_files)], 0.2 / n_files)})
    limits = np.array(bounds, np.int64)

    def encode(batches):
        import zstandard

        words = word_encoder(path)
        shared = zstandard.ZstdCompressionDict(content)
        shared.precompute_compress(level=3)  # else every frame digests the dictionary again
        pack = zstandard.ZstdCompressor(dict_data=shared)
        for batch in batches:
            ids = words.packed(batch.column(1), end)
            docs_ids = batch.column(0)
            raw = docs_ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.searchsorted(limits, raw, "right"), pa.int32()), docs_ids, pa.array([len(x) // words.width for x in ids], pa.int64()), pa.array([pack.compress(x) for x in ids], pa.binary())],
                ["file", "doc_id", "n", "frame"],
            )

    def save(batches):
        opened = None
        for batch in batches:
            for file, doc_id, n, frame in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if opened is None or opened.file != file:
                    if opened:
                        yield opened.close()
                    opened = _Writer(folder, file, width, sha)
                opened.add(doc_id, n, frame)
        if opened:
            yield opened.close()

    encoded = docs.mapInArrow(encode, "file int, doc_id long, n long, frame binary")
    ordered = encoded.repartition(partitions(spark), "file").sortWithinPartitions("file", F.col("doc_id").asc_nulls_first(), "n", "frame")
    files = stash(ordered.mapInArrow(save, "file int, path string, n_docs long, n_tokens long"), folder, "manifest").collect()  # a row per file
    rows, start = [], 0
    for r in sorted(files, key=lambda r: r.file):
        rows.append((r.file, r.path, sha.hex(), r.n_docs, r.n_tokens, start))
        start += r.n_tokens
    return spark.createDataFrame(rows, "file int, path string, dictionary string, n_docs long, n_tokens long, start long")


@lru_cache(maxsize=4)
def _dict(content: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(content)


class _Writer:
    """A file under a name of its own per attempt; only files of finished attempts reach the manifest."""

    def __init__(self, folder: str, file: int, width: int, sha: bytes):
        self.file, self.path, self.index, self.at, self.tokens = file, f"{folder}/ids-{file:06d}-{uuid.uuid4().hex}.ktok", [], HEAD.size, 0
        fs, path = open_fs(self.path)
        self.out = fs.open_output_stream(path)
        self.out.write(HEAD.pack(MAGIC, width, sha))

    def add(self, doc_id: int | None, n: int, frame: bytes) -> None:
        self.out.write(frame)
        self.index.append((doc_id or 0, doc_id is not None, self.at, len(frame), n))
        self.at += len(frame)
        self.tokens += n

    def close(self) -> pa.RecordBatch:
        self.out.write(np.array(self.index, INDEX_ROW).tobytes())
        self.out.write(TAIL.pack(len(self.index), self.at, END_MAGIC))
        self.out.close()
        return pa.RecordBatch.from_arrays([pa.array([self.file], pa.int32()), pa.array([self.path]), pa.array([len(self.index)], pa.int64()), pa.array([self.tokens], pa.int64())], ["file", "path", "n_docs", "n_tokens"])


class Reader:
    """Reads a file's index, then documents by position."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = open_fs(uri)
        self.input = fs.open_input_file(path)
        magic, width, sha = HEAD.unpack(self.input.read_at(HEAD.size, 0))
        size = self.input.size()
        n, index_at, end_magic = TAIL.unpack(self.input.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC or end_magic != END_MAGIC:
            raise ValueError(f"{uri} is no token-id file")
        self.dtype = f"<u{width}"
        self.index = np.frombuffer(self.input.read_at(size - TAIL.size - index_at, index_at), INDEX_ROW)
        if len(self.index) != n:
            raise ValueError(f"{uri}: its index is cut short")
        content = self._content(fs, f"{path.rpartition('/')[0]}/dictionary-{sha.hex()}.zdict", sha)
        self.unpack = zstandard.ZstdDecompressor(dict_data=_dict(content))

    @staticmethod
    def _content(fs, path: str, sha: bytes) -> bytes:
        with fs.open_input_file(path) as f:
            content = f.read()
        if hashlib.sha256(content).digest() != sha:
            raise ValueError(f"{path} is not the dictionary that the file was written with")
        return content

    def _ids(self, frame: bytes, n: int) -> np.ndarray:
        ids = np.frombuffer(self.unpack.decompress(frame, max_output_size=max(1, n * int(self.dtype[2]))), self.dtype)
        if len(ids) != n:
            raise ValueError("a document's ids are not as many as its index says")
        return ids

    def ids(self, k: int) -> np.ndarray:
        row = self.index[k]
        return self._ids(self.input.read_at(int(row["size"]), int(row["offset"])), int(row["n"]))

    def all(self):
        """(doc_id, ids) in file order; frames are read in blocks."""
        first = 0
        while first < len(self.index):
            begin, last = int(self.index["offset"][first]), first + 1
            while last < len(self.index) and int(self.index["offset"][last]) + int(self.index["size"][last]) - begin <= READ_BLOCK:
                last += 1
            end = int(self.index["offset"][last - 1]) + int(self.index["size"][last - 1])
            block = self.input.read_at(end - begin, begin)
            for r in self.index[first:last]:
                at = int(r["offset"]) - begin
                yield (int(r["doc_id"]) if r["has_id"] else None), self._ids(block[at : at + int(r["size"])], int(r["n"]))
            first = last


def read(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start (ids before it), n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers)."""
    spark = manifest.sparkSession
    ready(spark)

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for doc_id, ids in Reader(path).all():
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    spread = manifest.select("path", "start").repartition(partitions(spark))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])
