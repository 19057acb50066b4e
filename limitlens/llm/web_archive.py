"""Web archives with a two-level capture index.

Pages become WARC records, each a gzip member of its own, in files in the shared folder.
Captures are sorted by reversed-host URL key into compressed blocks. Each index file ends
with the sparse directory of its blocks; one row per index file is the level above. A lookup
binary-searches the files, then the directory, reads one block, finds the captures in it, and
reads exactly their bytes of the archive.

What a task has written counts only if its rows arrive: rows name the file, so files of
failed or repeated attempts are never referred to.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from limitlens.llm import words as W
from limitlens.plans.joins import lookup_join
from limitlens.plans.reuse import materialized
from limitlens.session import ensure_checkpoint_dir

#: Captures in a compressed block of the index, and bytes from which an archive file is closed.
BLOCK_CAPTURES, FILE_BYTES = 1000, 1 << 30
_DATE = "1970-01-01T00:00:00Z"

_CAPTURE = "urlkey string, page_id long, file string, offset long, length long, digest string, kind string"


def url_key(url: Column) -> Column:
    """Reversed host, then ")" and the rest: com,example,www)/path. A null url has an empty key."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.regexp_replace(url, r"(?s)^[^/?#]*?://", "")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    name = F.regexp_replace(F.lower(host), r"(?s)^.*@", "")
    return F.when(url == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(name, r"\.")), ","), F.lit(")"), F.substring(rest, F.length(host) + 1, F.length(rest))))


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value: str) -> str:
    """Header values hold no control characters or non-ASCII: those are percent-encoded."""
    return re.sub(r"[^\x20-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def record_bytes(page_id, url: str | None, payload: bytes, refers_to) -> tuple[bytes, str, str]:
    """A WARC record as a gzip member, with the payload's digest and the record's type."""
    digest = _digest(payload)
    kind = "response" if refers_to is None else "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    name = "null" if page_id is None else page_id
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {_header(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(raw) + packer.flush(), digest, kind


def parse_record(member: bytes) -> dict:
    """The fields of a record, and its payload checked against length and digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or _digest(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    ident = lambda v: None if v is None or v == "<urn:page:null>" else int(v[10:-1])
    return {
        "page_id": ident(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload": payload if fields["WARC-Type"] == "response" else None,
        "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": ident(fields.get("WARC-Refers-To")),
    }


def with_references(pages: DataFrame, key: str, url: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): the smallest page_id with an equal payload, if another.

    Payloads under ``least_bytes`` refer to none. Rows with a null id come after all others,
    and where no row of a payload has an id, none refers to another.
    """
    text = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    pages = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text.alias("payload"))
    equal = (F.sha2("payload", 256).alias("sha"), F.octet_length("payload").alias("size"))
    thin = pages.filter(F.octet_length("payload") >= least_bytes).select("page_id", *equal)
    groups = materialized(thin.groupBy("sha", "size").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null"))
    return (
        lookup_join(pages.select("*", *equal), groups.drop("n"), ["sha", "size"], bound=groups)
        .withColumn("refers_to", F.expr("case when refers_to <=> page_id then null else refers_to end")).drop("sha", "size")
    )


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_archive(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes records of (page_id, url, payload, refers_to) and returns the captures, stored."""
    keyed = pages.select(url_key(F.col("url")).alias("urlkey"), "page_id", "url", "payload", "refers_to")

    def run(batches):
        files, base = _open(folder)
        out, offset, name = None, 0, ""
        try:
            for batch in batches:
                rows = []
                for urlkey, page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None:
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                    member, digest, kind = record_bytes(page_id, url, payload.encode("utf-8", "surrogatepass"), refers_to)
                    out.write(member)
                    rows.append((urlkey, page_id, name, offset, len(member), digest, kind))
                    offset += len(member)
                    if offset >= file_bytes:
                        out.close()
                        out = None
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _types)], _names)
        finally:
            if out is not None:
                out.close()

    _names = [c.split()[0] for c in _CAPTURE.split(", ")]
    _types = [pa.string() if c.endswith("string") else pa.int64() for c in _CAPTURE.split(", ")]
    return materialized(W.map_batches(keyed, run, _CAPTURE))


def _place(urlkey: str, page_id: int | None) -> tuple:
    """Order of captures; a null id comes first."""
    return (urlkey, page_id is not None, page_id or 0)


def build_index(captures: DataFrame, folder: str, block: int = BLOCK_CAPTURES) -> list[tuple]:
    """Writes sorted, blocked index files; returns (first, last, file) of each, in order.

    There is one file for each range of keys, so the list is as long as the shuffle has
    partitions.
    """
    ordered = captures.repartitionByRange("urlkey", "page_id").sortWithinPartitions("urlkey", "page_id", "file", "offset")

    def run(batches):
        files, base = _open(folder)
        out, offset, name, directory, lines, ends = None, 0, "", [], [], []

        def close_block():
            nonlocal offset, lines
            packed = zlib.compress(json.dumps(lines).encode())
            out.write(packed)
            directory.append([lines[0][:2], offset, len(packed)])
            offset += len(packed)
            lines = []

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{uuid.uuid4().hex}.cdx"
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                    ends = [line[:2]]
                lines.append(line)
                if len(lines) == block:
                    close_block()
                last = line[:2]
        if out is not None:
            ends.append(last)
            if lines:
                close_block()
            packed = zlib.compress(json.dumps(directory).encode())
            out.write(packed + struct.pack("<QQ", offset, len(packed)))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(ends)]), pa.array([name])], ["ends", "file"])

    rows = W.map_batches(ordered, run, "ends string, file string").toArrow().to_pylist()
    parts = [(_place(*first), _place(*last), r["file"]) for r in rows for first, last in [json.loads(r["ends"])]]
    return sorted(parts)


class _Index:
    """Lookups of one task; keeps the directory and the block used last."""

    def __init__(self, folder: str, parts: list[tuple]):
        self.files, self.base = _open(folder)
        self.parts = parts
        self.lasts = [p[1] for p in parts]
        self.name, self.block_at, self.file = None, None, None

    def _load(self, name: str) -> None:
        if self.file is not None:
            self.file.close()
        self.file = self.files.open_input_file(f"{self.base}/{name}")
        size = self.file.size()
        offset, length = struct.unpack("<QQ", self.file.read_at(16, size - 16))
        self.directory = json.loads(zlib.decompress(self.file.read_at(length, offset)))
        self.firsts = [_place(*d[0]) for d in self.directory]
        self.name, self.block_at = name, None

    def find(self, urlkey: str, page_id: int | None) -> Iterator[list]:
        want = _place(urlkey, page_id)
        for part in range(bisect.bisect_left(self.lasts, want), len(self.parts)):
            first, _, name = self.parts[part]
            if first > want:
                return
            if name != self.name:
                self._load(name)
            # Equal keys may begin in the block before the first one that starts with them.
            at = max(0, bisect.bisect_left(self.firsts, want) - 1)
            while at < len(self.firsts) and self.firsts[at] <= want:
                if self.block_at != at:
                    _, offset, length = self.directory[at]
                    self.block = json.loads(zlib.decompress(self.file.read_at(length, offset)))
                    self.keys = [_place(*line[:2]) for line in self.block]
                    self.block_at = at
                low = bisect.bisect_left(self.keys, want)
                while low < len(self.keys) and self.keys[low] == want:
                    yield self.block[low]
                    low += 1
                at += 1


def lookup(wanted: DataFrame, folder: str, parts: list[tuple]) -> DataFrame:
    """Captures of the distinct (urlkey, page_id) of ``wanted``; keys come sorted, so blocks are read once."""
    held = wanted.sparkSession.sparkContext.broadcast(parts)
    ordered = wanted.select("urlkey", "page_id").distinct().repartitionByRange("urlkey", "page_id").sortWithinPartitions("urlkey", "page_id")

    def run(batches):
        index = _Index(folder, held.value)
        for batch in batches:
            rows = [line for k, p in zip(*(c.to_pylist() for c in batch.columns)) for line in index.find(k, p)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _types)], _names)

    _names = [c.split()[0] for c in _CAPTURE.split(", ")]
    _types = [pa.string() if c.endswith("string") else pa.int64() for c in _CAPTURE.split(", ")]
    return W.map_batches(ordered, run, _CAPTURE)


def read_records(captures: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Range-reads the records of captures, each file front to back."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    ordered = captures.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")

    def run(batches):
        files, base = _open(folder)
        name, source = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, files.open_input_file(f"{base}/{file}")
                rows.append(parse_record(source.read_at(length, offset)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[c.split()[1]]) for n, c in zip(names, schema.split(", "))], names)

    return W.map_batches(ordered, run, schema)


def archive_folder(spark) -> str:
    """A new folder for archives in the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/archive-{uuid.uuid4().hex}"
    spark.range(0).write.parquet(folder + "/made")  # makes the folder where the cluster keeps it
    return folder


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes all pages, indexes them, and reads every page back through the index.

    (page_id, url, payload_bytes, payload_digest, record_type, refers_to) per row. The
    payload is the text in UTF-8, a null an empty one; digest and size are those of the full
    payload. Of equal payloads the record with the smallest page_id is the response and the
    others revisit it. Rows that repeat the smallest id are responses too; a row with a null
    id refers to the smallest id, or is a response where there is none. A null url has an
    empty key and target. Further columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or archive_folder(spark)
    captures = write_archive(with_references(pages, key, url, payload, least_bytes), folder)
    parts = build_index(captures, folder)
    wanted = pages.select(url_key(F.col(url)).alias("urlkey"), F.col(key).cast("long").alias("page_id"))
    return read_records(lookup(wanted, folder, parts), folder)
