"""WARC records in ZIP packages: writing, and range reads without extraction.

An archive is a ZIP file (ZIP64 records included) with stored members only: data/records.warc.gz, where each
record is a gzip member of its own, and indexes/records.cdxj, one line a record with offset and length. The
reader parses the end records, the central directory and the index by range reads, turns them into rows, and
reads single records from the archive at their byte offsets.

Records of equal payload: the one with the largest page_id is the response, the others revisit it.

Defined cases: a null payload is empty; a very long payload is one record, held in memory by one task; small payloads
are never revisits; rows that share the largest page_id and the payload are all responses; a null page_id counts as
smaller than any, and records whose ids are all null are all responses; extra columns are ignored, whatever their names;
an empty table writes no archive and gives no rows.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.common import bounded_broadcast, materialize, shared_dir, table

#: Payloads below this many bytes are stored again.
LEAST_REVISIT = 1000
#: Compressed bytes after which an archive is closed and the next one begun.
ARCHIVE_BYTES = 32 << 20
#: Compressed bytes that a reading task takes on.
READ_BYTES = 4 << 20
DATA, INDEX = "data/records.warc.gz", "indexes/records.cdxj"

_END, _END64, _LOCATOR64, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


# -- records -------------------------------------------------------------------------------------------------


def _header(pairs: list[tuple[str, str | int]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs) + "\r\n").encode()


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One WARC record as a gzip member. A revisit has no block; digest and size are the full payload's."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    pairs: list[tuple[str, str | int]] = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Target-URI", clean)]
    pairs += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", size)]
    if refers_to is not None:
        pairs += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        payload = b""
    body = _header([*pairs, ("Content-Type", "text/html"), ("Content-Length", len(payload))]) + payload + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(body) + z.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


# -- ZIP directories -----------------------------------------------------------------------------------------


def _zip64_fields(extra: bytes, wanted: list[bool]) -> list[int | None]:
    """The 64-bit values of the ZIP64 extra field, which holds only those whose 32-bit field is full."""
    at = 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            out, p = [], at + 4
            for w in wanted:
                out.append(struct.unpack_from("<Q", extra, p)[0] if w else None)
                p += 8 * w
            return out
        at += 4 + size
    return [None] * len(wanted)


def read_directory(f, size: int) -> dict[str, tuple[int, int]]:
    """(offset of the content, length) of every stored member of the ZIP file f, by name.

    f needs seek() and read(). Only the end records, the central directory and the local headers are read.
    """

    def at(offset: int, n: int) -> bytes:
        f.seek(offset)
        return f.read(n)

    # the end record, the longest comment, and the ZIP64 locator before them
    tail_at = max(0, size - (22 + 65_535 + 20))
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(_END)
    while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
        end = tail.rfind(_END, 0, end)  # the letters stood in the comment
    if end < 0:
        raise ValueError("no end of central directory")
    entries, length, offset = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == _LOCATOR64:
        end64 = struct.unpack_from("<Q", tail, end - 12)[0]
        record = at(end64, 56)
        if record[:4] != _END64:
            raise ValueError("no ZIP64 end of central directory")
        entries, length, offset = struct.unpack_from("<QQQ", record, 32)
    directory, p, found = at(offset, length), 0, {}
    for _ in range(entries):
        if directory[p : p + 4] != _CENTRAL:
            raise ValueError("broken central directory")
        method, packed, plain, n, m, k, start = struct.unpack_from("<10xH8xIIHHH8xI", directory, p)
        name = directory[p + 46 : p + 46 + n].decode()
        full = [x == 0xFFFFFFFF for x in (plain, packed, start)]
        wide = _zip64_fields(directory[p + 46 + n : p + 46 + n + m], full)
        plain, packed, start = (w if w is not None else x for w, x in zip(wide, (plain, packed, start), strict=True))
        p += 46 + n + m + k
        if method == 0:
            local = at(start, 30)
            if local[:4] != _LOCAL:
                raise ValueError("broken local header")
            a, b = struct.unpack_from("<HH", local, 26)
            found[name] = (start + 30 + a + b, packed)
    return found


# -- Spark jobs ----------------------------------------------------------------------------------------------


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _package(records: bytes, index: list[str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, content in ((DATA, records), (INDEX, "".join(index).encode())):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as member:
                member.write(content)
    return out.getvalue()


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, payload, payload_digest, payload_bytes, refers_to) as archives; returns (path, bytes).

    Each task writes files of its own and puts them in place by a rename, so a task that runs again, or twice
    at once, leaves one whole copy. Names follow the task's partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        body, index, number, paths, sizes = bytearray(), [], 0, [], []

        def close():
            nonlocal body, index, number
            content = _package(bytes(body), index)
            name = f"part-{part:05d}-{number:05d}.wacz"
            with store.open_output_stream(f"{root}/.{name}.{attempt}") as f:
                f.write(content)
            store.move(f"{root}/.{name}.{attempt}", f"{root}/{name}")
            paths.append(f"{folder}/{name}")
            sizes.append(len(content))
            body, index, number = bytearray(), [], number + 1

        for b in batches:
            for page_id, url, payload, digest, size, refers_to in zip(*(b.column(i) for i in range(6)), strict=True):
                member = record_bytes(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), size.as_py(), refers_to.as_py())
                index.append(json.dumps({"page": page_id.as_py(), "offset": len(body), "length": len(member)}) + "\n")
                body += member
                if len(body) >= ARCHIVE_BYTES:
                    close()
        if index:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return records.select("page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to").mapInArrow(run, "path string, bytes long")


def locate_records(archives: DataFrame) -> DataFrame:
    """(path, offset, length): where each record lies within its archive, from directories and indexes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size in zip(b.column("path").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                store, name = _store(path)
                with store.open_input_file(name) as f:
                    members = read_directory(f, size)
                    start, (at, n) = members[DATA][0], members[INDEX]
                    f.seek(at)
                    lines = [json.loads(x) for x in f.read(n).splitlines()]
                cols = [pa.array([path] * len(lines)), pa.array([start + x["offset"] for x in lines], pa.int64()), pa.array([x["length"] for x in lines], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["path", "offset", "length"])

    return archives.select("path", "bytes").mapInArrow(run, "path string, offset long, length long")


def read_records(located: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Range-read records: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for a revisit)."""
    arrow_id = pa.int64() if id_type == "bigint" else pa.string()
    number = (lambda s: None if s == "null" else int(s)) if id_type == "bigint" else (lambda s: None if s == "null" else s)
    schema = f"page_id {id_type}, url string, record_type string, payload_bytes long, payload_digest string, refers_to {id_type}, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [arrow_id, pa.string(), pa.string(), pa.int64(), pa.string(), arrow_id, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f = None, None
        for b in batches:
            rows, held = [], 0
            for p, offset, length in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if p != path:
                    if f:
                        f.close()
                    store, name = _store(p)
                    path, f = p, store.open_input_file(name)
                f.seek(offset)
                h, block = parse_record(f.read(length))
                kind, refers = h["WARC-Type"], h.get("WARC-Refers-To")
                own = lambda x: number(x[len("<urn:page:") : -1])
                rows.append((own(h["WARC-Record-ID"]), h["WARC-Target-URI"], kind, int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), own(refers) if refers else None, block if kind == "response" else None))
                held += len(block)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        if f:
            f.close()

    # as many ranges as the records' bytes need: their places alone would look like little work
    located = materialize(located)
    tasks = max(1, -(-(located.agg(F.sum("length")).first()[0] or 0) // READ_BYTES))
    spread = located.repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset")
    return spread.select("path", "offset", "length").mapInArrow(run, schema)


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Adds payload (binary), payload_bytes, payload_digest and refers_to to page_id and url."""
    kind = pages.select("page_id").schema[0].dataType
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    named = pages.select(F.col("page_id").cast("long" if kind.typeName() in ("integer", "long", "short", "byte") else "string").alias("page_id"), "url", payload.alias("payload"))
    named = named.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    # only payloads that occur twice need a lookup; their digests are counted before any text moves
    twice = named.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    twice = bounded_broadcast(materialize(twice))
    joined = named.join(twice, ["payload_digest", "payload_bytes"], "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))).drop("first_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page as a WARC record, then read the archives back."""
    records = with_revisits(table(spark, sf_dir, "pages"))
    archives = materialize(write_archives(records, shared_dir(spark)))
    return read_records(locate_records(archives)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
