"""WARC archives: a gzip member per record, read back sequentially with every digest verified."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kestrel.llm.common import open_fs, partitions, ready, shared_dir, stash, text_or_empty

DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Uncompressed bytes after which a task begins another file, and bytes read from a file at once.
FILE_BYTES, BLOCK = 1 << 30, 1 << 20
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _line(value: str) -> str:
    """A header value has no line breaks."""
    return " ".join(value.split())


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    own = [("WARC-Type", kind), ("WARC-Date", DATE), *fields, ("WARC-Block-Digest", "sha1:" + _base32(hashlib.sha1(block).digest())), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in own) + "\r\n"
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>")]
    if url is not None:
        fields.append(("WARC-Target-URI", _line(url)))
    fields.append(("WARC-Payload-Digest", "sha1:" + _base32(hashlib.sha1(payload).digest())))
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    return _record("revisit" if revisit else "response", fields, http if revisit else http + payload)


def write(pages: DataFrame, id_col: str = "page_id", url_col: str | None = "url", html_col: str = "html", least: int = 0, folder: str | None = None) -> DataFrame:
    """Archives every row; returns the manifest (path, n_records), a row per file.

    Null html is an empty payload.  Among equal payloads of at least `least` bytes the largest id is
    the response and the others revisit it; null ids are below all others, rows that repeat the
    largest id are all responses, and where all ids are null all rows are.  An empty table gives no
    files.  Equality is that of SHA-1 and length.
    """
    spark = pages.sparkSession
    ready(spark)
    folder = folder or shared_dir(spark, "warc")
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), text_or_empty(F.col(html_col)).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= least, F.concat_ws(":", F.sha1("payload"), F.octet_length("payload"))))
    copies = rows.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = stash(copies, folder, "copies")
    with_copies = rows.join(copies, "digest", "left")
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    ready_rows = with_copies.select("page_id", "url", "payload", "largest", revisit.alias("revisit"))
    open_fs(folder)[0].create_dir(open_fs(folder)[1], recursive=True)

    def save(batches):
        out, path, n, size = None, "", 0, 0
        for batch in batches:
            for page_id, address, payload, largest, again in zip(*(batch.column(i) for i in range(5)), strict=True):
                if out is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    fs, at = open_fs(path)
                    out = fs.open_output_stream(at, compression=None)
                    out.write(_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")], b"software: kestrel\r\n"))
                payload = payload.as_py()
                out.write(page_record(page_id.as_py(), address.as_py(), payload, largest.as_py(), again.as_py()))
                n, size = n + 1, size + len(payload)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n_records"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n_records"])

    return stash(ready_rows.mapInArrow(save, "path string, n_records long"), folder, "manifest")


def members(stream):
    """The uncompressed content of each gzip member, one after the other; input is read and expanded block by block."""
    unpack, parts, begun = zlib.decompressobj(31), [], False
    while block := stream.read(BLOCK):
        while block:
            parts.append(unpack.decompress(block))
            begun = True
            block = b""
            if unpack.eof:
                yield b"".join(parts)
                block, unpack, parts, begun = unpack.unused_data, zlib.decompressobj(31), [], False
    if begun:
        raise ValueError("the archive ends inside a record")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block; framed by Content-Length, block digest verified."""
    head, found, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(fields["content-length"])
    block, end = rest[:length], rest[length:]
    if len(block) != length or end != b"\r\n\r\n":
        raise ValueError("a record is not as long as its Content-Length says")
    said = fields.get("warc-block-digest")
    if said and said != "sha1:" + _base32(hashlib.sha1(block).digest()):
        raise ValueError("a record's block does not match its digest")
    return fields, block


def _urn(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def page_row(fields: dict[str, str], block: bytes) -> tuple | None:
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    head, _, payload = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    size, digest = int(http["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or _base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError("a payload does not match its digest")
    return _urn(fields["warc-record-id"]), size, digest, kind, _urn(fields.get("warc-refers-to"))


def read(manifest: DataFrame) -> DataFrame:
    """One row per page record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Records of repeated rows and of pages without an id or payload have a row like others; no archives
    give no rows.  A record that is cut short, or whose digest is wrong, raises an error.
    """
    spark = manifest.sparkSession
    ready(spark)
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in RESULT.split(", ")]

    def rows_of(path):
        fs, at = open_fs(path)
        with fs.open_input_stream(at, compression=None) as stream:
            for member in members(stream):
                if row := page_row(*parse(member)):
                    yield row

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for row in rows_of(path):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return manifest.select("path").repartition(partitions(spark)).mapInArrow(run, RESULT)
