"""WARC archives with an index: write, select, read back by coalesced byte ranges.

Each task writes its pages as one archive of gzip members, one per record, into the shared folder, and returns the
index: path, offset, length, URL and payload digest of each record. The index is a table, and what a failed
or repeated attempt has written is in no row of it. Readers select index rows, deal them out by stretch of
an archive, sort them by offset and join ranges that lie close together into one read.

Records with equal payloads (of a minimum size) are written once: the page with the smallest id is a
``response``, the others are ``revisit`` records without payload that refer to it.

Defined cases: a null html is an empty payload, a null URL becomes ``urn:missing``; of rows that repeat id and payload
the first written is the response, the rest refer to their own id; one id with different payloads is
several records; a page without id is always a response; an empty table gives an empty index; further
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyrisk.llm.common import spread_lookup, write_out
from tallyrisk.session import scratch_path

# An archive is closed and the next begun beyond so many bytes.
ARCHIVE_BYTES = 256 << 20
# Ranges closer than GAP are read as one, up to READ bytes; an index is dealt out by STRETCH bytes of an archive.
GAP, READ, STRETCH = 64 << 10, 8 << 20, 32 << 20
ROWS_PER_TASK = 100_000
LEVEL = 4
DATE = "2000-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))

INDEX = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("payload_digest", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("offset", T.LongType()),
    T.StructField("length", T.LongType()),
])
RECORD = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()),
    T.StructField("payload", T.BinaryType()),
])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record."""
    revisit = refers_to is not None
    block = _HTTP.format(len(payload)).encode("ascii") + (b"" if revisit else payload)
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {quote(url, safe=_PRINTABLE) if url else 'urn:missing'}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        headers += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    return "\r\n".join(headers).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """The columns of RECORD from one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError("the payload does not fit its digest")
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    return number("WARC-Record-ID"), fields["WARC-Target-URI"], kind, number("WARC-Refers-To"), size, digest, payload


def with_originals(pages: DataFrame, page_id: str, url: str, html: str, least: int) -> DataFrame:
    """page_id, url, html and refers_to (null for responses)."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("html"), F.sha1(body).alias("sha1"))
    narrow = rows.where(F.octet_length("html") >= least).select("page_id", "sha1")
    groups = narrow.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    groups = write_out(groups.where("copies > 1"), "warc-groups")
    later = spread_lookup(narrow, groups, "sha1", "copies", F.xxhash64("page_id"), ROWS_PER_TASK).where("page_id <> first_id")
    originals = later.select("page_id", "sha1", F.col("first_id").alias("refers_to")).distinct()
    # Dealt out by id and payload, pages without id each for itself: a hot id is spread, the payloads are shuffled once.
    alone = F.xxhash64("url", "sha1", F.monotonically_increasing_id())
    dealt = rows.withColumns({"deal": F.coalesce("page_id", alone), "no_id": F.col("page_id").isNull()}).repartition("deal", "no_id", "sha1")
    keyed = originals.select(F.col("page_id").alias("deal"), F.lit(False).alias("no_id"), "sha1", "refers_to")
    return dealt.join(keyed, ["deal", "no_id", "sha1"], "left").select("page_id", "url", "html", "refers_to")


def write_archives(
    pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0
) -> DataFrame:
    """Write the pages; returns the index. ``least``: payload bytes from which equal payloads become revisits."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    ready = with_originals(pages, page_id, url, html, least).sortWithinPartitions("page_id", F.sha1("html"))
    fields = to_arrow_schema(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, path, offset, last = None, "", 0, None
        try:
            for batch in batches:
                rows = []
                for page, address, text, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or offset >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        path, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{path}", compression=None)
                    payload = text.encode("utf-8")
                    digest = base32_sha1(payload)
                    if page is not None and (page, digest) == last and len(payload) >= least:
                        refers_to = page if refers_to is None else refers_to
                    last = (page, digest)
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    data = packer.compress(record(page, address, payload, digest, refers_to)) + packer.flush()
                    out.write(data)
                    rows.append((page, address, digest, f"{folder}/{path}", offset, len(data)))
                    offset += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields) if rows else pa.RecordBatch.from_pylist([], schema=fields)
        finally:
            if out is not None:
                out.close()

    return write_out(ready.mapInArrow(run, INDEX), "warc-index")


def ranges(rows: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Sorted (offset, length) joined to (offset, length, number of rows) reads."""
    out: list[tuple[int, int, int]] = []
    for offset, length in rows:
        if out and offset - (out[-1][0] + out[-1][1]) <= GAP and offset + length - out[-1][0] <= READ:
            start, _, n = out[-1]
            out[-1] = (start, offset + length - start, n + 1)
        else:
            out.append((offset, length, 1))
    return out


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the selected index rows. Payload digests are checked."""
    chosen = index.select("path", "offset", "length", F.floor(F.col("offset") / STRETCH).alias("stretch"))
    # As many tasks as the bytes to read need, not as the small index would.
    tasks = -(-(chosen.agg(F.sum("length")).first()[0] or 0) // READ)
    dealt = chosen.repartition(max(1, tasks), "path", "stretch").sortWithinPartitions("path", "offset")
    fields = to_arrow_schema(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, offsets, lengths = (batch.column(k).to_pylist() for k in range(3))
            begin = 0
            while begin < len(paths):
                end = begin
                while end < len(paths) and paths[end] == paths[begin]:
                    end += 1
                store, path = fs.FileSystem.from_uri(paths[begin])
                with store.open_input_file(path) as source:
                    at = begin
                    for start, length, n in ranges(list(zip(offsets[begin:end], lengths[begin:end]))):
                        data = memoryview(source.read_at(length, start))
                        rows = []
                        for k in range(at, at + n):
                            member = data[offsets[k] - start : offsets[k] - start + lengths[k]]
                            row = parse(zlib.decompress(member, 31))
                            rows.append(row if payloads else (*row[:-1], None))
                        at += n
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)
                begin = end

    return dealt.mapInArrow(run, RECORD)
