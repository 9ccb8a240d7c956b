"""WARC archives: a writer with duplicate detection and a splittable reader.

Writing: equal payloads are found by digest (pre-aggregated to one winner for each digest that occurs twice), a task
streams its rows as one gzip member a record to a temporary file in the shared folder and renames it at the end, so a
repeated task replaces its file as a whole. Payloads are not shuffled where the table of repeated digests can be broadcast;
beyond BROADCAST_DIGESTS they are joined under salts, so a page that a host serves without end is split. Reading: byte
ranges are made by executors from the table of files. A task looks for the gzip magic in its range, takes a candidate for
a member only if it inflates to a WARC header, and owns the records that start inside; it reads on past its end to
finish the last one.

Edge cases: null html is an empty payload, null urls and page ids leave their header out and come back as null;
rows with the page_id and payload of the response are responses too; payloads under `least` bytes are never
revisits; an empty table writes no archive and reads as no rows; magic bytes inside compressed data are refused by
the header check; a very long payload is held in memory once compressed and once as it is, in time that grows with its
length; other columns of the pages, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import persist_shared, scratch_path, small_batches

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PROBE = 1 << 16
SALTS = 64
#: Digests that occur more than once, of 64 bytes each, up to which they are broadcast.
BROADCAST_DIGESTS = 400_000


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def with_record_types(pages: DataFrame, *, least: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type and refers_to of each page."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    long = F.octet_length("payload") >= least
    used = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_salt"))).alias("_bits")
    seen = rows.where(long).groupBy(F.col("payload_digest").alias("_digest")).agg(F.max("page_id").alias("_winner"), F.count(F.lit(1)).alias("_n"), used)
    winners = persist_shared(seen.where("_n > 1 and _winner is not null").select("_digest", "_winner", "_bits"), "digests")
    if winners.count() <= BROADCAST_DIGESTS:
        joined = rows.join(F.broadcast(winners), long & (F.col("payload_digest") == F.col("_digest")), "left")
    else:
        each = F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.col("_bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)) != 0))
        spread = winners.select("_digest", "_winner", each.alias("_z"))
        found = rows.where(long).join(spread, (F.col("payload_digest") == F.col("_digest")) & (F.col("_salt") == F.col("_z")), "left").select(*rows.columns, "_winner")
        joined = found.unionByName(rows.where(~long), allowMissingColumns=True)
    again = F.col("_winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_winner"))
    return joined.select(
        "page_id", "url", "payload", "payload_digest",
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(again, F.col("_winner")).alias("refers_to"),
    )


def record_id(page_id: int | None, digest: str) -> str:
    h = hashlib.md5(f"{page_id}:{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        head.append(("WARC-Target-URI", _clean(url)))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    raw = VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


FILES = "path string, bytes bigint, records bigint"


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write the rows of with_record_types(); path, bytes and records of each archive, one a partition with rows."""

    def work(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        name = f"{base}/part-{ctx.partitionId():06d}.warc.gz"
        tmp = f"{name}.attempt-{ctx.taskAttemptId()}"
        size = records = 0
        with fs.open_output_stream(tmp) as out:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    size += out.write(data := record(*row)) or len(data)
                    records += 1
        if records:
            fs.move(tmp, name)
        else:
            fs.delete_file(tmp)
        yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [size], "records": [records]})

    small_batches(rows.sparkSession)
    cols = rows.select("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")
    return persist_shared(cols.mapInArrow(work, FILES), "archives").where("records > 0")


class _Range:
    """A window over a file that grows to the right as bytes are asked for."""

    def __init__(self, file, start: int, size: int, step: int = 1 << 20):
        self.file, self.size, self.step = file, size, step
        self.base, self.data = start, bytearray()

    def drop_before(self, at: int) -> None:
        """Forget what lies before `at`; what was dropped once is read again."""
        if self.base <= at <= self.base + len(self.data):
            del self.data[: at - self.base]
        else:
            self.data.clear()
        self.base = at

    def upto(self, end: int) -> None:
        end = min(end, self.size)
        have = self.base + len(self.data)
        if end > have:
            self.file.seek(have)
            self.data += self.file.read(max(end - have, min(self.step, self.size - have)))

    def find_magic(self, at: int, limit: int) -> int:
        """The first place of the magic in [at, limit), or -1."""
        while at < limit:
            self.upto(min(limit + 2, at + self.step))
            have = self.base + len(self.data)
            i = self.data.find(MAGIC, at - self.base)
            if i >= 0:
                return self.base + i if self.base + i < limit else -1
            if have >= min(limit + 2, self.size):
                return -1
            at = max(at, have - 2)
            self.drop_before(at)
        return -1

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The inflated member at `at` and where it ends; None unless it is a WARC record."""
        z, out, pos, known = zlib.decompressobj(31), bytearray(), at, False
        try:
            while not z.eof:
                self.upto(pos + PROBE)
                chunk = bytes(self.data[pos - self.base : pos - self.base + PROBE])
                if not chunk:
                    break
                out += z.decompress(chunk)
                pos += len(chunk)
                if not known and (len(out) >= 5 or z.eof):
                    if out[:5] != b"WARC/":
                        break
                    known = True
                if known:
                    self.drop_before(pos)
        except zlib.error:
            known = False
        if not known or not z.eof:
            self.drop_before(at)
            return None
        end = pos - len(z.unused_data)
        self.drop_before(end)
        return bytes(out), end


def parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its header")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"), "payload": payload,
    }


def records_of(file, start: int, end: int, size: int) -> Iterator[dict]:
    """The records that start in [start, end)."""
    view, at = _Range(file, start, size), start
    while (at := view.find_magic(at, end)) >= 0:
        got = view.member(at)
        if got is None:
            at += 1
            continue
        raw, at = got
        yield parse(raw)


FIELDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def splits(files: DataFrame, split_bytes: int) -> DataFrame:
    """path, a, b, n: the byte ranges [a, b) of files of n bytes."""
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split_bytes).cast("bigint")))
    return files.where("bytes > 0").select("path", at.alias("a"), F.col("bytes").alias("n")).select("path", "a", F.least(F.col("a") + split_bytes, "n").alias("b"), "n")


def read_archives(spark: SparkSession, folder: str, files: DataFrame, *, split_bytes: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """The records of the archives (path in the folder's file system, bytes)."""
    fields = FIELDS + (", payload binary" if payloads else "")
    names = [f.split()[0] for f in fields.split(", ")]
    parts = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    tasks = splits(files, split_bytes).repartition(int(min(parts, 20_000)))

    def work(batches):
        fs, _ = _fs(folder)
        for batch in batches:
            for path, a, b, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                with fs.open_input_file(path) as f:
                    for r in records_of(f, a, b, n):
                        rows.append(r)
                        held += len(r["payload"])
                        if held > 4 << 20 or len(rows) >= 5000:
                            yield to_batch(rows)
                            rows, held = [], 0
                if rows:
                    yield to_batch(rows)

    def to_batch(rows):
        kinds = {"url": pa.string(), "payload_digest": pa.string(), "record_type": pa.string(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(k, pa.int64())) for k in names], names=names)

    return tasks.mapInArrow(work, fields)


def round_trip(pages: DataFrame, *, split_bytes: int = 8 << 20, payloads: bool = False) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    files = write_archives(with_record_types(pages), folder)
    return read_archives(spark, folder, files, split_bytes=split_bytes, payloads=payloads)
