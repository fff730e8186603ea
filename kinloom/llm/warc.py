"""WARC archives: a writer of one gzip member per record, and a reader that splits files anywhere.

Writing: pages with equal payloads (by SHA-1) keep one response, that of the largest id; the others become
revisit records that refer to it. Each task writes a file of its own name and returns it; the table of the
returned names is the archive, so that a task that was lost or run twice leaves only a file nobody reads.

Reading: a task takes a byte range, scans it for gzip's magic number, decodes each candidate until its first bytes
come out (a member's own header may be of any length) and goes on only if these begin a WARC header; it owns the records
that start in its range, also where they end beyond it. After an owned record the next begins at once, or the scan starts anew.
A member that begins as a WARC record and is damaged or cut off ends the job with an error that names its place, or,
where the caller asks, is a row of type "damaged"; the scan goes on behind its first byte.

A null html is an empty payload; a page with a null id is a response, and no other record refers to it;
rows that repeat the largest id of their payload are all responses; an empty table gives an archive without
files; columns besides the three named are not looked at. A url's control characters are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, new_path, opened, ship

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
SLICE = 1 << 16
LEAST = 4096
BEGIN = b"WARC/1."
SALT = 16
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, file string, offset long"


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(len(payload)))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block = http + payload
    else:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE), ("WARC-Truncated", "length")]
        block = http
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    text = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return pack.compress(text.encode("utf-8") + block + b"\r\n\r\n") + pack.flush()


def parsed(raw: bytes) -> tuple | None:
    """page_id, url, type, payload_bytes, digest, refers_to, payload of a decoded member; None if it is no
    response or revisit."""
    top, _, block = raw.partition(b"\r\n\r\n")
    lines = top.decode("utf-8", "replace").split("\r\n")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    kind = head.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    block = block[: int(head.get("content-length", len(block)))]
    said = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
        return number(head.get("warc-record-id")), head.get("warc-target-uri"), kind, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), None, payload
    length = head.get("warc-payload-length")
    return number(head.get("warc-record-id")), head.get("warc-target-uri"), kind, None if length is None else int(length), said, number(head.get("warc-refers-to")), None


class Damaged(ValueError):
    """A member that begins as a WARC record and can't be decoded to its end."""


def decoded(read, at: int) -> tuple[bytes, int] | None:
    """The member that begins at byte `at` and where it ends; None if none does, an error if one does that is
    damaged. read(at) gives bytes."""
    out, unpack, size, begins = [], zlib.decompressobj(31), 0, False
    while not unpack.eof:
        chunk = read(at) if begins else read(at)[:512]
        try:
            if not chunk:
                raise EOFError
            out.append(unpack.decompress(chunk))
        except (zlib.error, EOFError) as e:
            if begins:
                raise Damaged("cut off" if isinstance(e, EOFError) else str(e)) from None
            return None
        size += len(out[-1])
        if not begins and size:
            start = b"".join(out)[: len(BEGIN)]
            if not BEGIN.startswith(start):
                return None
            begins = len(start) == len(BEGIN)
        at += len(chunk)
    return (b"".join(out), at - len(unpack.unused_data)) if begins else None


def records(f, start: int, end: int) -> Iterator[tuple[int, bytes | Damaged]]:
    """(offset, decoded member or what is wrong with it) of the members that start in [start, end) of an open file."""
    held, past = [0, b""], [None]  # a block of the file, and where the file ends once that is known

    def read(at: int) -> bytes:
        """Bytes from `at` on: at least LEAST of them, or those to the end of the file."""
        if not held[0] <= at or at + LEAST > held[0] + len(held[1]) and past[0] != held[0] + len(held[1]):
            f.seek(at)
            held[:] = [at, f.read(max(CHUNK, LEAST))]
            if len(held[1]) < max(CHUNK, LEAST):
                past[0] = at + len(held[1])
        return held[1][at - held[0] : at - held[0] + SLICE]

    at = start
    while at < end:
        chunk = read(at)
        if not chunk:
            return
        if not chunk.startswith(MAGIC):
            k = chunk.find(MAGIC, 1)
            at += k if k > 0 else max(1, len(chunk) - 2)  # it may begin in the last two bytes
            continue
        try:
            got = decoded(read, at)
        except Damaged as e:
            got = None
            yield at, e
        if got is None:
            at += 1
            continue
        yield at, got[0]
        at = got[1]


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives and returns the table of their files: (path, bytes, n_records).
    Payloads under min_bytes are never revisits."""
    spark = pages.sparkSession
    ship(spark)
    folder = folder or new_path(spark, "warc")
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    named = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary").alias("payload"))
    # Who refers to whom is decided on ids and digests; payloads are then dealt by page, so that one that a third of
    # all pages share (the empty one) is no hot key. Its ids are: the digest's response is salted to them.
    named = named.withColumn("digest", F.sha1("payload"))
    ids = named.where(F.col("page_id").isNotNull() & (F.octet_length("payload") >= min_bytes)).select("page_id", "digest")
    last = ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    last = last.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    revisits = ids.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int")).join(last, ["digest", "salt"]).where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    joined = named.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "refers_to")

    def written(batches):
        import pyarrow as pa

        path, size, n, out = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0, None
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or opened(path, write=True)
                packed = member(page_id, url, payload, None if page_id is None else refers_to)
                out.write(packed)
                size, n = size + len(packed), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": pa.array([size], pa.int64()), "n_records": pa.array([n], pa.int64())})

    return Written(joined.mapInArrow(written, "path string, bytes long, n_records long"), "warc-files", few=True).df


def read_archives(files: DataFrame, split_bytes: int = 32 << 20, payloads: bool = True, damaged: str = "fail") -> DataFrame:
    """The response and revisit records of the files in a table with columns path and bytes. damaged: "fail" ends
    the job at a damaged member, "report" gives a row of type damaged with its file and offset alone."""
    if damaged not in ("fail", "report"):
        raise ValueError("damaged must be fail or report")
    spark: SparkSession = files.sparkSession
    ship(spark)
    ranges = files.select("path", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {split_bytes}L)")).alias("start"))
    ranges = ranges.repartition(max(1, ranges.count()))  # a range is a task

    def read(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, size = [], 0
                with opened(path) as f:
                    for offset, raw in records(f, start, start + split_bytes):
                        if isinstance(raw, Damaged):
                            if damaged == "fail":
                                raise Damaged(f"{path}, byte {offset}: {raw}")
                            rows.append((None, None, "damaged", None, None, None, None, path, offset))
                        elif (x := parsed(raw)) is not None:
                            rows.append((*x[:6], x[6] if payloads else None, path, offset))
                            size += len(raw) if payloads else 200
                            if size > 4 << 20:
                                yield packed(rows)
                                rows, size = [], 0
                if rows:
                    yield packed(rows)

    return ranges.mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, min_bytes: int = 0, split_bytes: int = 32 << 20, **columns: str) -> DataFrame:
    """Writes the pages, reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    out = read_archives(write_archives(pages, min_bytes=min_bytes, **columns), split_bytes, payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
