"""WARC archives compressed with Zstandard: one record, one frame.

A file starts with a skippable frame that holds the dictionary; every further
frame holds one whole record (the first one a ``warcinfo``). Tasks write their
own files under fresh names and report them in a manifest; only files of the
manifest are read, so what a lost or repeated task attempt leaves behind does
no harm. Reading goes frame by frame, so a task never holds more than one
record, and checks version line, mandatory headers, declared lengths, the blank
lines at the end, and block and payload digests.

Folders are URIs that ``pyarrow.fs`` opens on an executor (file, hdfs, s3, gs).

Cases: a null payload is an empty one; a null URL leaves out the target
header; control characters of a URL are percent-encoded; a record with a null
key is always a full response and has no key when read; of rows that share both
key and payload, all are responses if that key is the largest. An empty table
gives an empty manifest and no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, functions as F

from cellstrata.llm.labelled import sampled
from cellstrata.plans.lineage import cut, shared_dir, written

_SKIP = 0x184D2A5D  # the skippable frame that holds a dictionary
_MAGIC = 0xFD2FB528
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "file string, records long, bytes long"
_READ = "record_id string, record_type string, url string, page_id long, payload_bytes long, payload_digest string, refers_to long"


# ---- frames and records -------------------------------------------------


def frames(f) -> Iterator[tuple[str, bytes]]:
    """``("skip", content)`` or ``("zstd", whole frame)`` for every frame of an open file."""

    def take(n: int) -> bytes:
        b = f.read(n)
        if len(b) != n:
            raise ValueError(f"the archive ends within a frame: {len(b)} of {n} bytes")
        return b

    while head := f.read(4):
        if len(head) != 4:
            raise ValueError("the archive ends within a frame's magic number")
        (magic,) = struct.unpack("<I", head)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            yield "skip", take(*struct.unpack("<I", take(4)))
            continue
        if magic != _MAGIC:
            raise ValueError(f"not a Zstandard frame: {magic:#x}")
        flags = take(1)
        one_segment, check, size, ids = flags[0] >> 5 & 1, flags[0] >> 2 & 1, flags[0] >> 6, flags[0] & 3
        parts = [head, flags, take((not one_segment) + (0, 1, 2, 4)[ids] + (one_segment, 2, 4, 8)[size])]
        last = False
        while not last:
            parts.append(block := take(3))
            (b,) = struct.unpack("<I", block + b"\0")
            last = bool(b & 1)
            parts.append(take(1 if b >> 1 & 3 == 1 else b >> 3))
        if check:
            parts.append(take(4))
        yield "zstd", b"".join(parts)


def _sha1(b: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def build(kind: str, record_id: str, date: str, block: bytes, **headers: str | None) -> bytes:
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date}
    lines |= {k.replace("_", "-"): v for k, v in headers.items() if v is not None}
    lines |= {"WARC-Block-Digest": _sha1(block), "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one whole record; raises where it breaks the format."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not mark or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError(f"bad header line {line[:80]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"{name} is missing")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"the block has {len(rest) - 4} bytes, its header says {headers['content-length']}")
    block = rest[:-4]
    if headers.get("warc-block-digest", _sha1(block)) != _sha1(block):
        raise ValueError(f"block digest of {headers['warc-record-id']} does not match")
    return headers, block


def _http(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; ``file:/x`` and a bare path count as local."""
    if re.match(r"file:/|/", folder):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", folder)
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", folder))


# ---- operators ----------------------------------------------------------


def revisits(pages: DataFrame, min_bytes: int = 1000, most: int = 500_000) -> DataFrame:
    """``(page_id, url, payload, digest, refers_to)``; ``refers_to`` is null for responses.

    The largest key of each payload comes from a partially aggregated maximum,
    so a payload that a third of the pages share is not gathered anywhere. Up to
    ``most`` repeated payloads (some 60 bytes each) are broadcast, so that the
    pages stay where they are; beyond, Spark joins by a shuffle, which it can
    split where it is skewed.
    """
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    last = (
        p.where((F.col("n") >= min_bytes) & F.col("page_id").isNotNull())
        .select(F.unhex("digest").alias("sha1"), "n", "page_id")
        .groupBy("sha1", "n")
        .agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    last = cut(last)
    last = F.broadcast(last) if last.count() <= most else last
    return p.withColumn("sha1", F.unhex("digest")).join(last, ["sha1", "n"], "left").select(
        "page_id", "url", "payload", "digest", F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to")
    )


def dictionary(pages: DataFrame, rows: int = 400, chars: int = 8000, size: int = 32_768) -> bytes:
    """A dictionary from a bounded sample of pages (it affects sizes only, no content)."""
    some = pages.select("page_id", F.substring("html", 1, chars).alias("html")).where("html is not null and html <> ''")
    sample = sampled(some, "page_id", rows, repeats=True).limit(2 * rows).collect()
    texts = [_http(len(r["html"])) + r["html"].encode() for r in sample]
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too uniform samples
        return b"".join([_http(0), *texts])[-size:]


def write_archives(
    records: DataFrame, folder: str, words: bytes, file_bytes: int = 256 << 20, date: str = "1970-01-01T00:00:00Z", level: int = 3
) -> DataFrame:
    """Write ``revisits`` rows into archives; the manifest of the files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(folder)
        files.create_dir(path, recursive=True)
        known = zstandard.ZstdCompressionDict(words)
        pack = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True, write_content_size=True)
        out, name, n, size = None, "", 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_pylist([{"file": name, "records": n, "bytes": size}])

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is not None and size >= file_bytes:
                    yield done()
                    out = None
                if out is None:
                    base, n = f"part-{uuid.uuid4().hex}.warc.zst", 0
                    name, out = f"{folder}/{base}", files.open_output_stream(f"{path}/{base}", compression=None)
                    out.write(struct.pack("<II", _SKIP, len(words)) + words)
                    info = build("warcinfo", f"urn:uuid:{uuid.uuid4()}", date, b"format: WARC File Format 1.1\r\n", Content_Type="application/warc-fields")
                    out.write(frame := pack.compress(info))
                    size = 8 + len(words) + len(frame)
                target = None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~|{}^`\"<>\\ ")
                http = _http(len(payload))
                own = {
                    "WARC_Target_URI": target,
                    "Content_Type": "application/http; msgtype=response",
                    "WARC_Payload_Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
                }
                record_id = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
                if refers_to is None:
                    record = build("response", record_id, date, http + payload, **own)
                else:
                    record = build("revisit", record_id, date, http, WARC_Refers_To=f"<urn:page:{refers_to}>", WARC_Profile=_PROFILE, **own)
                out.write(frame := pack.compress(record))
                n, size = n + 1, size + len(frame)
        if out is not None:
            yield done()

    return written(records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, _MANIFEST), "warc-manifest")


def _read_one(files: pafs.FileSystem, path: str, with_payload: bool) -> Iterator[dict]:
    with files.open_input_stream(path, compression=None, buffer_size=1 << 20) as f:
        unpack = zstandard.ZstdDecompressor()
        for place, (kind, content) in enumerate(frames(f)):
            if kind == "skip":
                if place == 0 and content:
                    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
                continue
            headers, block = parse(unpack.decompressobj().decompress(content))
            kind, record_id = headers["warc-type"], headers["warc-record-id"].strip("<>")
            if kind not in ("response", "revisit"):
                continue
            http, mark, payload = block.partition(b"\r\n\r\n")
            length = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", http)
            if not mark or not length or not http.startswith(b"HTTP/"):
                raise ValueError(f"{record_id}: bad HTTP header")
            declared = headers.get("warc-payload-digest", "")
            if kind == "response" and (len(payload) != int(length[1]) or declared not in ("", _sha1(payload))):
                raise ValueError(f"{record_id}: payload of {len(payload)} bytes does not match its headers")
            if kind == "revisit" and (payload or "warc-refers-to" not in headers or not declared):
                raise ValueError(f"{record_id}: bad revisit record")
            key = lambda s: int(m[1]) if (m := re.fullmatch(r"<?urn:page:(-?\d+)>?", s or "")) else None
            yield {
                "record_id": record_id,
                "record_type": kind,
                "url": headers.get("warc-target-uri"),
                "page_id": key(record_id),
                "payload_bytes": int(length[1]),
                "payload_digest": base64.b32decode(declared.removeprefix("sha1:")).hex() if declared else hashlib.sha1(payload).hexdigest(),
                "refers_to": key(headers.get("warc-refers-to")),
            } | ({"payload": payload if kind == "response" else None} if with_payload else {})


def read_archives(manifest: DataFrame, with_payload: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """A row per response and revisit record of the files in the column ``file`` (URIs or paths).

    The files are dealt to as many tasks as there are files, by name.
    """
    schema = _READ + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        form = pa.schema(list(zip(names, types)))
        rows, size = [], 0
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                for row in _read_one(*_open(uri), with_payload):
                    rows.append(row)
                    size += 400 + len(row.get("payload") or b"")
                    if size >= batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, form)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, form)

    return manifest.select("file").repartition(max(1, manifest.count()), "file").mapInArrow(read, schema)


def op4_warc(pages: DataFrame) -> DataFrame:
    """Write a record per page, read the archives back."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(revisits(pages), folder, dictionary(pages))
    return read_archives(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
