"""WARC records in ZIP-packaged archives: written by tasks, and read by range without extraction.

An archive is a ZIP file with two stored members: ``archive/data.warc.gz``, each record a gzip member of its own, and
``indexes/index.cdxj``, a line with offset and length for each record. The reader parses the end-of-central-directory record, the ZIP64 one
where there is one, and the central directory; it locates the members, reads the index, and fetches runs of records as byte ranges.

Defined cases: a null html is an empty payload; among records with equal payloads of ``least`` bytes or more those with the largest page_id
are responses and the others revisit it (rows that repeat the largest page_id are all responses); rows without page_id never are the one
that others refer to, and are responses if their payload has no other page; a null url gives no target header; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import make_dir, materialize, new_path, open_read, open_write

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_MANIFEST = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("bytes", pa.int64())])
BROADCAST_ROWS = 500_000


class ZipWriter:
    """Writes stored members of unknown size to a stream; ZIP64 records where a number passes ``limit``."""

    def __init__(self, out, limit: int = 0xFFFFFFFF):
        self.out, self.limit, self.at, self.members = out, limit, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.members.append({"name": name.encode(), "start": self.at, "crc": 0, "size": 0})
        # bit 3: sizes follow the data; version 45: they have 8 bytes there
        self._write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x808, 0, 0, 0x21, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name.encode()), 20) + name.encode() + struct.pack("<HHQQ", 1, 16, 0, 0))

    def add(self, data: bytes) -> None:
        m = self.members[-1]
        m["crc"], m["size"] = zlib.crc32(data, m["crc"]), m["size"] + len(data)
        self._write(data)

    def end(self) -> None:
        m = self.members[-1]
        self._write(struct.pack("<IIQQ", 0x08074B50, m["crc"], m["size"], m["size"]))

    def close(self) -> None:
        start = self.at
        for m in self.members:
            far = m["size"] >= self.limit or m["start"] >= self.limit
            extra = struct.pack("<HHQQQ", 1, 24, m["size"], m["size"], m["start"]) if far else b""
            sizes = (0xFFFFFFFF,) * 2 if far else (m["size"],) * 2
            self._write(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x808, 0, 0, 0x21, m["crc"], *sizes, len(m["name"]), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if far else m["start"]) + m["name"] + extra)
        size, n = self.at - start, len(self.members)
        far = start >= self.limit
        if far:
            end = self.at
            self._write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, start))
            self._write(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
        self._write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, size, 0xFFFFFFFF if far else start, 0))
        self.out.close()


def members_of(file) -> dict[str, tuple[int, int]]:
    """Start and size of the data of each stored member of a ZIP file that can be read at any place."""
    length = file.size()
    tail = file.read_at(min(length, 65_557), length - min(length, 65_557))
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of a central directory: not a ZIP file")
    n, size, start = struct.unpack_from("<HII", tail, at + 10)
    base = length - len(tail)
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        (place,) = struct.unpack_from("<Q", tail, at - 12)
        n, size, start = struct.unpack("<QQQ", file.read_at(56, place)[32:56])
    elif start + size != base + at:
        raise ValueError("the central directory is not where it should be")
    directory, found, at = file.read_at(size, start), {}, 0
    for _ in range(n):
        magic, _, _, _, method, _, _, _, packed, full, names, extras, notes, _, _, _, header = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
        if magic != 0x02014B50:
            raise ValueError("a broken central directory")
        name = directory[at + 46 : at + 46 + names].decode()
        extra, k = directory[at + 46 + names : at + 46 + names + extras], 0
        while k + 4 <= len(extra):
            kind, room = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # ZIP64: only the numbers that don't fit, in this order
                wide = list(struct.unpack_from(f"<{room // 8}Q", extra, k + 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            k += 4 + room
        if method == 0:
            local = file.read_at(30, header)
            found[name] = (header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
        at += 46 + names + extras + notes
    return found


def _clean(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or one that revisits another page: it holds the HTTP header only."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>", "WARC-Date: 2000-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        head.append(f"WARC-X-Page: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record; checks its digest if it has the payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(line for line in http.decode().split("\r\n") if line.lower().startswith("content-length:")).split(":")[1])
    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"a broken record of page {fields.get('warc-x-page')}")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("warc-x-page"), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number("warc-x-refers-to-page"), "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None}


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0, archive_bytes: int = 256 << 20, zip64_from: int = 0xFFFFFFFF, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` and return the manifest: path, n_records, bytes. Payloads stay in their partition and only digests are shuffled; beyond ``BROADCAST_ROWS`` groups, payloads outside the large groups are shuffled once."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    make_dir(folder)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    groups = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "keeper", "n")
    groups = materialize(groups, "same-payload")
    facts = groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    # at most BROADCAST_ROWS groups hold this share of the rows or more; only the others, none of them large, are joined by a shuffle
    large = F.lit(facts["groups"] <= BROADCAST_ROWS) | (F.col("n") * BROADCAST_ROWS >= facts["rows"])
    rows = rows.join(F.broadcast(groups.where(large).select("digest", "keeper", F.lit(True).alias("placed"))), "digest", "left")
    if facts["groups"] > BROADCAST_ROWS:
        others = rows.where("placed is null").drop("keeper", "placed").join(groups.where(~large).select("digest", "keeper"), "digest", "left")
        rows = rows.where("placed").drop("placed").unionByName(others)
    refers = F.when(F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper"))
    rows = rows.select("page_id", "url", "payload", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, lines, path, at = None, [], "", 0

        def close() -> pa.RecordBatch:
            archive.end()
            archive.begin(INDEX)
            for k in range(0, len(lines), 1000):
                archive.add("".join(lines[k : k + 1000]).encode())
            archive.end()
            archive.close()
            return pa.RecordBatch.from_pylist([{"path": path, "n_records": len(lines), "bytes": archive.at}], schema=_MANIFEST)

        for batch in batches:
            for page, target, body, keeper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive is None:
                    path, lines, at = f"{folder}/{uuid.uuid4().hex}.wacz", [], 0
                    archive = ZipWriter(open_write(path), zip64_from)
                    archive.begin(DATA)
                packed = gzip.compress(record(page, target, body, keeper), 3, mtime=0)
                archive.add(packed)
                lines.append(f"{_clean(target or '-').replace(' ', '%20')} 20000101000000 {json.dumps({'offset': at, 'length': len(packed)})}\n")
                at += len(packed)
                if at >= archive_bytes:
                    yield close()
                    archive = None
        if archive is not None:
            yield close()

    return materialize(rows.mapInArrow(write, "path string, n_records long, bytes long"), "warc-manifest")


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """The archives of a folder, as a manifest (their content isn't read)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wacz").option("recursiveFileLookup", True).load(folder).select("path", F.lit(None).cast("long").alias("n_records"), F.col("length").alias("bytes"))


def read_archives(manifest: DataFrame, payload: bool = True, range_bytes: int = 8 << 20) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, and the payload (null in revisits) if wanted."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            with open_read(path) as file:
                members = members_of(file)
                start, _ = members[DATA]
                index = file.read_at(members[INDEX][1], members[INDEX][0]).decode()
            places = [json.loads(line[line.index("{") :]) for line in index.split("\n") if line]
            rows, run = [], []
            for k, p in enumerate(places):
                run.append(p["length"])
                if k + 1 == len(places) or sum(run) >= range_bytes or places[k + 1]["offset"] != p["offset"] + p["length"]:
                    rows.append({"path": path, "start": start + p["offset"] + p["length"] - sum(run), "sizes": run})
                    run = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("sizes", pa.list_(pa.int64()))]))

    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())] + [("payload", pa.binary())] * payload
    schema = pa.schema(kinds)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            with open_read(row["path"]) as file:
                data, at, rows = file.read_at(sum(row["sizes"]), row["start"]), 0, []
            for size in row["sizes"]:
                found = parse(gzip.decompress(data[at : at + size]))
                at += size
                rows.append({k: found[k] for k, _ in kinds})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    n = max(1, manifest.count())
    ranges = manifest.select("path").repartition(n).mapInArrow(locate, "path string, start long, sizes array<long>")
    return ranges.repartition(2 * n).mapInArrow(fetch, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payload)
