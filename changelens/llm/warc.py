"""Operator 5: WARC archives, written per record as gzip members and read in splits."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import join_spread, partitions
from .common import fresh_path, store, written

MAGIC = b"\x1f\x8b\x08"
#: Bytes that a task owns, and bytes that it reads at a time.
SPLIT_BYTES, READ_BYTES = 8 << 20, 1 << 20
#: Decoded bytes by which a candidate member is judged at first; a WARC header may go on beyond them.
HEADER_BYTES = 64 << 10


def _gzip(data: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit of the page refers_to without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {(url or '').translate({10: None, 13: None})}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields, by lower-case name, and the block; None for what is no whole WARC record."""
    top, found, rest = data.partition(b"\r\n\r\n")
    lines = top.decode("utf-8", "surrogateescape").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = fields.get("content-length", "")
    return (fields, rest[: int(n)]) if n.isdigit() and int(n) <= len(rest) else None


def owned_records(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """Decoded members whose gzip magic stands in [start, end) of a seekable file.

    A magic number inside compressed data is a candidate only: its member must decode to a WARC header, which ends with a
    blank line and may be of any length; decoding goes on to that line or to the member's end.
    From a valid member the next begins at its end. The last owned member is read beyond `end` as far as it goes, so
    neighbouring splits neither lose nor repeat a record. Memory is one read and one record.
    """
    window, base = b"", start
    sure = start == 0

    def fill(upto: int) -> None:
        nonlocal window
        while base + len(window) < min(upto, size):
            file.seek(base + len(window))
            more = file.read(READ_BYTES)
            if not more:
                break
            window += more

    at = start
    while at < min(end, size):
        window, base = window[at - base :], at
        fill(at + READ_BYTES)
        found = 0 if sure and window.startswith(MAGIC) else window.find(MAGIC)
        sure = False
        if found < 0:
            if base + len(window) >= size:
                return
            at = base + len(window) - 2
            continue
        at = base + found
        if at >= end:
            return
        z = zlib.decompressobj(31)
        try:
            head = bytearray(z.decompress(window[found:], HEADER_BYTES))
            used = len(window) - found
            blank = head.find(b"\r\n\r\n")
            while not z.eof and (z.unconsumed_tail or at + used < size) and (len(head) < HEADER_BYTES or blank < 0 and head.startswith(b"WARC/1.")):
                fill(at + used + READ_BYTES)
                seen = len(head)
                head += z.decompress(z.unconsumed_tail + window[found + used :], HEADER_BYTES - seen if seen < HEADER_BYTES else READ_BYTES)
                used = len(window) - found
                if blank < 0:
                    blank = head.find(b"\r\n\r\n", max(0, seen - 3))
        except zlib.error:
            at += 1
            continue
        if not head.startswith(b"WARC/1.") or blank < 0 or b"warc-type:" not in head[:blank].lower():
            at += 1
            continue
        data = [head]
        while not z.eof:
            tail = z.unconsumed_tail
            if not tail:
                fill(at + used + READ_BYTES)
                tail = window[found + used :]
                used = len(window) - found
                if not tail:
                    raise ValueError(f"a WARC record that starts at byte {at} is cut short")
            data.append(z.decompress(tail, READ_BYTES))
        at += used - len(z.unused_data)
        sure = True
        yield b"".join(data)


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as archives below path and return (file, n_bytes, n_records).

    Of pages with equal payloads of min_revisit_bytes or more that with the largest page_id keeps it (a null page_id
    only where all are null), the others become revisits; null payloads are empty ones. Equal payloads meet as digests, counted
    before the join, which deals out the pages of a frequent digest. A task writes
    under a name of its attempt and then renames, so a repeated or lost task leaves one whole file. Other columns are ignored.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("html"), F.sha1(payload).alias("_d"))
    keys = pages.select(F.col("page_id").cast("long"), F.sha1(payload).alias("_k"), F.octet_length(payload).alias("_n")).filter(F.col("_n") >= min_revisit_bytes)
    again = keys.groupBy(F.col("_k").alias("_d")).agg(F.max("page_id").alias("_top"), F.count("*").alias("_c")).filter("_c > 1")
    typed = join_spread(rows, again, "_d", "_c", pages.count(), [F.col("page_id"), F.col("url")])
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_top")), F.col("_top"))
    typed = typed.select("page_id", "url", "html", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, folder = store(path)
        context = TaskContext.get()
        disk.create_dir(folder, recursive=True)
        name = f"{folder}/part-{context.partitionId():06d}.warc.gz"
        temporary = f"{folder}/.{context.partitionId()}-{context.taskAttemptId()}"
        size = n = 0
        with disk.open_output_stream(temporary) as out:
            for b in batches:
                for x in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    data = _gzip(record(x[0], x[1], x[2], x[3]))
                    out.write(data)
                    size, n = size + len(data), n + 1
        disk.move(temporary, name)
        yield pa.RecordBatch.from_arrays([pa.array([f"part-{context.partitionId():06d}.warc.gz"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["file", "n_bytes", "n_records"])

    return written(typed.mapInArrow(run, "file string, n_bytes long, n_records long"), "warc-manifest")


def read_archives(spark: SparkSession, path: str, manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of the records below path.

    Each task scans a byte range. For a response the payload is taken from the block and its digest is computed and
    held against the header; a revisit has no payload, and its length and digest come from its headers. An archive
    without records gives no row; a response whose digest doesn't match fails the job. A pass before counts the records
    of each file by the same ranges, and a file that holds others than n_records of the manifest is an error.
    """
    ranges = manifest.filter("n_bytes > 0").select("file", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    parts = partitions(spark)
    ranges = ranges.repartition(parts, "file", "start")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, folder = store(path)
        for b in batches:
            found = []
            for name, size, start in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                with disk.open_input_file(f"{folder}/{name}") as file:
                    found.append(sum(1 for _ in owned_records(file, size, start, start + split_bytes)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], ["file", "n"])

    n_read = ranges.mapInArrow(count, "file string, n long").groupBy("file").agg(F.sum("n").alias("n_read"))
    held = manifest.select("file", "n_records").join(n_read, "file", "left").withColumn("n_read", F.coalesce("n_read", F.lit(0)))
    off = held.filter("n_read != n_records").first()
    if off is not None:
        raise ValueError(f"{off['file']} holds {off['n_read']} records that can be read, the manifest has {off['n_records']}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, folder = store(path)
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for b in batches:
            for name, size, start in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                with disk.open_input_file(f"{folder}/{name}") as file:
                    rows: list[tuple] = []
                    held = 0
                    for data in owned_records(file, size, start, start + split_bytes):
                        rows.append(_row(data))
                        held += len(data)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return ranges.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def _urn(value: str) -> int | None:
    digits = value.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _row(data: bytes) -> tuple:
    got = parse(data)
    if got is None:
        raise ValueError(f"no whole WARC record: {data[:80]!r}")
    fields, block = got
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "revisit":
        n = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
        return _urn(fields["warc-record-id"]), fields["warc-target-uri"], kind, _urn(fields["warc-refers-to"]), n, digest, None
    if sha1_base32(payload) != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
    return _urn(fields["warc-record-id"]), fields["warc-target-uri"], kind, None, len(payload), digest, payload


def digest(pages: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    manifest = write_archives(pages, path)
    return read_archives(spark, path, manifest, split_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
