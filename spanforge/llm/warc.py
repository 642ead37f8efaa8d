"""WARC archives of gzip members: a writer that makes revisits of repeated payloads, and a splittable reader.

The reader lists the archives, cuts them into byte ranges and reads the ranges in parallel. A task
looks for gzip magic from the start of its range; a candidate counts only if it inflates to a WARC
header. The task owns the records whose member starts inside its range, and reads the last of them
beyond the range's end.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import free_name, with_place

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
CRLF = b"\r\n"


def payload_digest(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _member(head: list[tuple[str, str]], parts: list[bytes]) -> bytes:
    """One record as a gzip member."""
    size = sum(map(len, parts))
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in [*head, ("Content-Length", str(size))])]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = [pack.compress("\r\n".join(lines).encode() + CRLF * 2)]
    raw += [pack.compress(p) for p in parts]
    return b"".join([*raw, pack.compress(CRLF * 2), pack.flush()])


def _clean(value: str) -> str:
    """A header value stays on its line."""
    return " ".join(value.split())


def _record_id(page_id: object, uid: int) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{uid}').urn}>"


def _record(row: dict, date: str) -> bytes:
    body = (row["html"] or "").encode()
    digest, url = payload_digest(body), _clean(row["url"] or "")
    head = [("WARC-Type", "revisit" if row["refers_uid"] is not None else "response"), ("WARC-Record-ID", _record_id(row["page_id"], row["uid"])), ("WARC-Date", date)]
    head += [("WARC-Target-URI", url)] if url else []
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    head += [("X-Page-Id", str(row["page_id"]))] if row["page_id"] is not None else []
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    if row["refers_uid"] is None:
        return _member(head, [http, body])
    head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(row["refers_to"], row["refers_uid"]))]
    head += [("X-Refers-To-Page-Id", str(row["refers_to"]))] if row["refers_to"] is not None else []
    return _member(head, [http])


def with_originals(pages: DataFrame, least: int = 0) -> DataFrame:
    """Adds refers_to and refers_uid to the pages whose payload, of at least `least` bytes, an earlier page has.

    Earlier is by page_id, null last, then by place in the files. Payloads are equal if length, SHA-1
    and xxHash64 agree.
    """
    body = F.coalesce("html", F.lit(""))
    place = free_name(pages, "place")
    rows = with_place(pages, place).select("page_id", "url", "html", F.col(place).alias("uid"), F.octet_length(body).alias("size"), F.sha1(body).alias("sha"), F.xxhash64(body).alias("hash"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "uid"))
    groups = rows.filter(F.col("size") >= least).groupBy("sha", "hash").agg(F.max("size").alias("size"), first.alias("first"), F.count("*").alias("n"))
    # Joined by size too, which deals both sides anew, so that Spark can split a hot group.
    groups = groups.filter("n > 1").select("sha", "hash", "size", F.col("first.page_id").alias("refers_to"), F.col("first.uid").alias("refers_uid"))
    out = rows.join(groups, ["sha", "hash", "size"], "left")
    other = F.col("refers_uid") != F.col("uid")
    return out.select("page_id", "url", "html", "uid", F.when(other, F.col("refers_to")).alias("refers_to"), F.when(other, F.col("refers_uid")).alias("refers_uid"))


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")


def write_warc(pages: DataFrame, folder: str, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes one archive for each partition into folder and returns path, records and bytes of each.

    pages has page_id, url and html. Of pages with equal payloads of at least `least` bytes, the one
    with the smallest page_id is a response and the others revisit it; null html is an empty
    payload; null page_ids and urls are left out of the record. Records are written as they come, so
    a task holds one at a time, and a file gets its name when it is whole: a task that runs twice
    leaves one file. Evaluating the result twice writes the archives twice. An empty table writes no
    archive and returns no rows; rows that repeat are records of their own; other columns are not read. A payload of any
    length is one record.
    """
    ready = with_originals(pages, least)

    def write(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, path = _filesystem(folder)
        fs.create_dir(path, recursive=True)
        name, unready = f"{path}/part-{part:06d}.warc.gz", f"{path}/.part-{part:06d}-{uuid.uuid4().hex}"
        records = size = 0
        with fs.open_output_stream(unready, compression=None) as out:
            for table in tables:
                for i in range(table.num_rows):
                    member = _record({k: table.column(k)[i].as_py() for k in table.schema.names}, date)
                    out.write(member)
                    records, size = records + 1, size + len(member)
        fs.move(unready, name)
        yield pa.RecordBatch.from_pydict({"path": [name], "records": [records], "bytes": [size]})

    return ready.mapInArrow(write, "path string, records long, bytes long")


class _Inflater:
    """Reads one gzip member of a file in blocks."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.at, self.z, self.rest, self.over = file, at, zlib.decompressobj(31), b"", False
        file.seek(at)

    def more(self, most: int = BLOCK) -> bytes:
        """The next bytes, b"" at the member's end; raises zlib.error on what is no member."""
        while not self.over:
            raw = self.rest or self.file.read(BLOCK)
            if not raw:
                raise zlib.error("cut off")
            out = self.z.decompress(raw, most)
            self.rest = self.z.unconsumed_tail
            if self.z.eof:
                self.over, self.rest = True, b""
                self.at += len(raw) - len(self.z.unused_data)
            else:
                self.at += len(raw) - len(self.rest)
            if out:
                return out
        return b""


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _read_record(file: pa.NativeFile, at: int, with_payload: bool) -> tuple[dict, int]:
    """The record of the member at a place, and where the member ends; zlib.error or ValueError if none is there."""
    z = _Inflater(file, at)
    raw = z.more(4096)
    if not raw.startswith(b"WARC/1."):
        raise ValueError("no record")
    while (end := raw.find(CRLF * 2)) < 0:
        if not (got := z.more()):
            raise ValueError("no end of header")
        raw += got
    head, body = _headers(raw[:end]), raw[end + 4 :]
    left = int(head.get("content-length", 0))
    http: dict[str, str] = {}
    if head.get("content-type", "").startswith("application/http"):
        while (end := body.find(CRLF * 2)) < 0 and len(body) < left and (got := z.more()):
            body += got
        if end >= 0:
            http, left, body = _headers(body[:end]), left - end - 4, body[end + 4 :]
    sha, size, parts = hashlib.sha1(), 0, []
    while body:
        part = body[: left - size]
        sha.update(part)
        size += len(part)
        if with_payload:
            parts.append(part)
        body = z.more()
    while z.more():
        pass
    number = lambda k: int(head[k]) if head.get(k, "").lstrip("-").isdigit() else None
    full = int(http.get("content-length", size)) if head.get("warc-type") == "revisit" else size
    return {
        "record_id": head.get("warc-record-id"),
        "record_type": head.get("warc-type"),
        "url": head.get("warc-target-uri"),
        "page_id": number("x-page-id"),
        "refers_to": number("x-refers-to-page-id"),
        "refers_to_id": head.get("warc-refers-to"),
        "payload_bytes": full,
        "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "found_digest": base64.b32encode(sha.digest()).decode() if head.get("warc-type") != "revisit" else None,
        "payload": b"".join(parts) if with_payload and head.get("warc-type") != "revisit" else None,
    }, z.at


def _candidates(file: pa.NativeFile, start: int, end: int) -> Iterator[int]:
    """Places of gzip magic that start in [start, end)."""
    at, tail = start, b""
    while at < end:
        file.seek(at)
        raw = file.read(min(BLOCK, end - at) + len(MAGIC) - 1)
        if not raw:
            return
        k = raw.find(MAGIC)
        while k >= 0:
            yield at + k
            k = raw.find(MAGIC, k + 1)
        at += BLOCK


FIELDS = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("refers_to_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("found_digest", pa.string()), ("payload", pa.binary())])

RECORDS = "record_id string, record_type string, url string, page_id long, refers_to long, refers_to_id string, payload_bytes long, payload_digest string, found_digest string, payload binary"


def records_in(file: pa.NativeFile, start: int, end: int, with_payload: bool) -> Iterator[dict]:
    """The records whose member starts in [start, end). What lies between members and can't be read is passed over."""
    at = start
    while at < end:
        for k in _candidates(file, at, end):
            try:
                record, at = _read_record(file, k, with_payload)
            except (zlib.error, ValueError):
                continue
            yield record
            while at < end:  # members mostly follow one another
                try:
                    record, at = _read_record(file, at, with_payload)
                except (zlib.error, ValueError):
                    at += 1
                    break
                yield record
            break
        else:
            return


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_warc(spark: SparkSession, folder: str, split_bytes: int = 32 << 20, with_payload: bool = True) -> DataFrame:
    """One row for each record of the *.warc.gz files in folder.

    page_id and refers_to are numbers, as pages have them; ids of other kinds, and archives of others that have none, give nulls
    there (record_id and refers_to_id tell records apart all the same).
    payload_bytes is the length of the full payload, of a revisit that of the payload it repeats;
    found_digest is the digest of the bytes read. payload is null for revisits and if not asked for. A folder without
    archives, or none at all (a table without rows makes none), gives no rows.
    """
    if not _exists(spark, folder):
        return spark.createDataFrame([], RECORDS)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0).cast("long")), F.lit(split_bytes).cast("long"))).alias("start"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, "length").alias("end")).repartition(parts, "path", "start")

    def read(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for path, start, end in zip(*(table.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                fs, name = _filesystem(path)
                with fs.open_input_file(name) as file:
                    rows, held = [], 0
                    for r in records_in(file, start, end, with_payload):
                        rows.append(r)
                        held += len(r["payload"] or b"")
                        if len(rows) >= 4096 or held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, FIELDS)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, FIELDS)

    return ranges.mapInArrow(read, RECORDS)
