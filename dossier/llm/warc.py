"""WARC archives: indexed writing, and reading of selected records by coalesced byte ranges.

Writing: each task writes one archive of gzip members (a record each) to the
shared folder and returns an index row for each record: file, offset, length,
URL and digest.  A file's name is new for each attempt and only a finished
attempt's rows are kept, so a lost executor leaves an unused file at most.
Reading: index rows are dealt by file and slab of bytes, sorted by offset, and
neighbouring ranges are fetched by one read.
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, salted_join, store

GAP_BYTES, SPAN_BYTES, SLAB_BYTES = 1 << 16, 1 << 22, 1 << 24
#: What WARC-Date says where pages do not say when they were fetched; fixed, so that a repeated task writes the same bytes.
DATE = "1970-01-01T00:00:00Z"
#: Revisits (page and target number: 16 bytes each) are broadcast up to this many, else joined by shuffling.
BROADCAST_ROWS = 200_000
INDEX = "page_id bigint, url string, file string, offset bigint, length bigint, payload_digest string, record_type string, refers_to bigint"
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _target(url: str | None) -> str:
    return "" if url is None else quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_target(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record; the payload's length is that of the payload, or what the HTTP head of a revisit says."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    revisit = fields["WARC-Type"] == "revisit"
    number = lambda s: None if s is None or s[10:-1] == "None" else int(s[10:-1])
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "record_type": fields["WARC-Type"],
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": number(fields.get("WARC-Refers-To")),
        "date": fields["WARC-Date"],
        "payload_bytes": int(said["Content-Length"]) if revisit else len(payload),
        "payload": payload,
    }


def first_copies(pages: DataFrame, id_col: str = "page_id", body: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id and refers_to of the pages whose payload of at least min_bytes equals that of a smaller page_id."""
    digests = store(pages.select(F.col(id_col).alias("page_id"), F.unhex(F.sha1(F.coalesce(body, F.lit("")))).alias("d"), F.octet_length(F.coalesce(body, F.lit(""))).alias("bytes")), "warc-digests")
    first = digests.where(F.col("bytes") >= min_bytes).groupBy("d").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last")
    # the rows of a frequent payload go to several tasks
    return salted_join(digests, first, ["d"], "page_id", "inner").where(F.col("page_id") > F.col("refers_to")).select("page_id", "refers_to").distinct()


def write(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Writes one record a row of pages (page_id, url, html) and returns the stored index; date is the WARC-Date of all of them.

    A null html is an empty payload; a null page_id is never a revisit or a
    target; rows repeated under the smallest page_id are all responses.
    """
    revisits = store(first_copies(pages, min_bytes=min_bytes), "warc-revisits")
    rows = pages.select("page_id", "url", "html")
    small = revisits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(revisits) if small else revisits, "page_id", "left")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        path, offset, out = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            index = []
            for page, url, html, target in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")]):
                out = out or files.open_output_stream(path, compression=None)
                payload = (html or "").encode()
                digest = digest32(payload)
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = pack.compress(record(page, url, payload, digest, target, date)) + pack.flush()
                out.write(member)
                index.append((page, url, path, offset, len(member), digest, "response" if target is None else "revisit", target))
                offset += len(member)
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()])], names=["page_id", "url", "file", "offset", "length", "payload_digest", "record_type", "refers_to"])
        if out:
            out.close()

    return store(rows.mapInArrow(task, INDEX), "warc-index")


def ranges(index: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Joins (offset, length) pairs in order of offset into reads: start, end and the records in it."""
    group: list[tuple[int, int]] = []
    for offset, length in sorted(index):
        if group and (offset - sum(group[-1]) > GAP_BYTES or offset + length - group[0][0] > SPAN_BYTES):
            yield group[0][0], sum(group[-1]), group
            group = []
        group.append((offset, length))
    if group:
        yield group[0][0], sum(group[-1]), group


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Fetches the records that the index rows name; each payload is checked against its digest.

    A revisit comes without its payload, a record of a null url with null.
    Index rows that are repeated are read once; columns of the index other
    than file, offset, length and url are not read; an empty index gives no
    rows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            wanted: dict[str, dict[int, tuple[int, str | None]]] = {}
            for f, o, n, url in zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "length", "url")]):
                wanted.setdefault(f, {})[o] = (n, url)
            for path, records in wanted.items():
                with files.open_input_file(path) as source:
                    for start, end, group in ranges([(o, n) for o, (n, _) in records.items()]):
                        raw, rows = source.read_at(end - start, start), []
                        for offset, length in group:
                            got = parse(zlib.decompress(raw[offset - start : offset - start + length], 31))
                            got.pop("date")
                            if got["record_type"] == "response" and digest32(got["payload"]) != got["payload_digest"]:
                                raise ValueError(f"{path}: the payload at {offset} does not match its digest")
                            rows.append(got | {"url": records[offset][1]} | ({} if payloads else {"payload": None}))
                        yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]))

    slab = F.floor(F.col("offset") / SLAB_BYTES)
    n = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = index.repartition(n, "file", slab).sortWithinPartitions("file", "offset")
    return dealt.select("file", "offset", "length", "url").mapInArrow(task, RECORD)


def roundtrip(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Writes all pages as archives, then reads all records back."""
    folder = new_path(pages.sparkSession, "warc-archives")
    return read(write(pages, folder), folder, payloads)
