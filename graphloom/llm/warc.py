"""WARC archives of pages as a chunked record table.

Payloads move as rows (record, chunk number, bytes), with the SHA-1 of all bytes up to the chunk's end carried along: the
writer compresses chunk by chunk into one gzip member a record, and the reader gives the same rows back from a stream, so
that no record is held whole on either side of the archive. Repeated payloads are revisit records without a payload.

Archives lie in the shared folder. A task writes a file under a name of its own; only the rows that Spark commits
say which files count, so what a lost or repeated task leaves behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import shared_folder, store

CHUNK_BYTES = 1 << 20
#: A task starts a new archive beyond this.
ARCHIVE_BYTES = 256 << 20
#: A stretch of an archive that one task reads.
READ_BYTES = 4 << 20
LEVEL = 1
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of every record: archives of the same pages are the same.
DATE = "2000-01-01T00:00:00Z"
ENTRY_SCHEMA = "page_id long, archive string, offset long, length long"
CHUNK_SCHEMA = "page_id long, record_type string, refers_to long, chunk long, data binary, payload_bytes long, digest string, last boolean"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_name(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _header(fields: list[tuple[str, object]]) -> bytes:
    lines = [f"{k}: {v}".replace("\r", "%0D").replace("\n", "%0A") for k, v in fields]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode()


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages with record_type, refers_to, payload (binary), sha1 (hex).

    Of pages with equal payloads of at least `least` bytes, that with the smallest id is the response, and so are rows that
    repeat this id; the others revisit it. Null html is an empty payload. A null id is a response if no page with
    an id has the payload. Payloads go through one exchange, by a hash of page and digest; the digests that repeat come to
    them in a join that spreads every digest over several keys.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    first = rows.where(F.length("payload") >= least).groupBy("sha1").agg(F.min("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1")
    first = store(first.select("sha1", "response_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(16)).cast("int"))
    joined = salted.join(first, ["sha1", "salt"], "left")
    revisit = F.col("response_id").isNotNull() & ~F.col("response_id").eqNullSafe(F.col("page_id"))
    return joined.select(
        "page_id", "url", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("response_id")).alias("refers_to"), F.when(revisit, F.lit(None)).otherwise(F.col("payload")).alias("payload"),
        F.length("payload").cast("long").alias("payload_bytes"), "sha1",
    )


class Archive:
    def __init__(self, folder: str):
        fs, path = pafs.FileSystem.from_uri(folder)
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        self.stream, self.at = fs.open_output_stream(f"{path}/{self.name}", compression=None), 0

    def begin(self, head: bytes):
        self.began, self.pack = self.at, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self.put(head)

    def put(self, data):
        self._put(self.pack.compress(data))

    def end(self) -> tuple[int, int]:
        """Ends the record's gzip member; its place in the archive."""
        self.put(b"\r\n\r\n")
        self._put(self.pack.flush())
        return self.began, self.at - self.began

    def _put(self, data: bytes):
        if data:
            self.stream.write(data)
            self.at += len(data)


def chunked(records: DataFrame) -> DataFrame:
    """plan_records' rows as chunk rows: payload gives way to chunk, chunks and data. A record's rows stay together and in order."""
    n = F.greatest(F.lit(1), F.ceil(F.coalesce(F.length("payload"), F.lit(0)) / CHUNK_BYTES)).cast("int")
    rows = records.withColumn("chunks", n).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.withColumn("data", F.substring("payload", F.col("chunk") * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES))).drop("payload")


def _record_head(page, url, kind, refers, size, sha1: bytes) -> bytes:
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_name(page)), ("WARC-Date", DATE), ("WARC-Target-URI", url or f"urn:page:{page}"),
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(sha1)), ("X-Page-ID", "" if page is None else page), ("X-Payload-Length", size),
    ]
    if kind == "revisit":
        fields += [("WARC-Refers-To", record_name(refers)), ("X-Refers-To-Page", refers), ("WARC-Profile", PROFILE)]
    length = len(HTTP_HEAD) + (size if kind == "response" else 0)
    return _header([*fields, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", length)]) + HTTP_HEAD


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes chunk rows; returns the table of what is where: page_id, archive, offset, length."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "sha1", "chunk", "chunks"]

    def run(batches):
        archive, sha1 = None, None
        for batch in batches:
            done, data = [], batch.column("data")
            for at, (page, url, kind, refers, size, digest, chunk, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
                if chunk == 0:
                    if archive is None or archive.at >= ARCHIVE_BYTES:
                        if archive:
                            archive.stream.close()
                        archive = Archive(folder)
                    archive.begin(_record_head(page, url, kind, refers, size, bytes.fromhex(digest)))
                    sha1 = hashlib.sha1()
                if kind == "response" and size:
                    part = data[at].as_buffer()
                    sha1.update(part)
                    archive.put(part)
                if chunk == n - 1:
                    if kind == "response" and sha1.hexdigest() != digest:
                        raise ValueError(f"page {page}: its chunks are not its payload")
                    done.append((page, archive.name, *archive.end()))
            if done:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], ["page_id", "archive", "offset", "length"])
        if archive:
            archive.stream.close()

    return store(chunks.mapInArrow(run, ENTRY_SCHEMA))


def read_member(stream, length: int):
    """Decompressed pieces of about CHUNK_BYTES of the gzip member that begins here."""
    unpack, left = zlib.decompressobj(31), length
    while left and not unpack.eof:
        data = stream.read(min(left, 1 << 16))
        if not data:
            raise ValueError("archive ends inside a record")
        left -= len(data)
        while data and not unpack.eof:
            yield unpack.decompress(data, CHUNK_BYTES)
            data = unpack.unconsumed_tail
    if not unpack.eof:
        yield unpack.flush()


def read_record(stream, length: int):
    """(header fields, None), then (chunk, sha1 so far) for each chunk of the payload, at least one."""
    pieces, held = read_member(stream, length), b""
    while b"\r\n\r\n" not in held:
        held += next(pieces)
    head, _, held = held.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    yield fields, None
    left, sha1, skip, made = int(fields["Content-Length"]), hashlib.sha1(), True, False
    buffer = bytearray(held)
    while True:
        if skip and (b"\r\n\r\n" in buffer):
            n = buffer.index(b"\r\n\r\n") + 4
            del buffer[:n]
            left -= n
            skip = False
        while not skip and left and len(buffer) >= min(left, CHUNK_BYTES):
            chunk = bytes(buffer[: min(left, CHUNK_BYTES)])
            del buffer[: len(chunk)]
            left -= len(chunk)
            sha1.update(chunk)
            made = True
            yield chunk, sha1.digest()
        if not left and not skip:
            break
        piece = next(pieces, None)
        if piece is None:
            raise ValueError("a record ends before its length")
        buffer += piece
    for _ in pieces:
        pass
    if not made:
        yield b"", sha1.digest()


def read_chunks(entries: DataFrame, folder: str, with_data: bool = True) -> DataFrame:
    """The chunk rows of archived records; digest is that of the payload up to and with the chunk, base32. A revisit has one
    chunk, without data, and the digest and length that its record states."""

    def run(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        files: dict[str, object] = {}
        for batch in batches:
            rows, held = [], 0
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive not in files:
                    for f in files.values():
                        f.close()
                    files = {archive: fs.open_input_file(f"{path}/{archive}")}
                files[archive].seek(offset)
                parts = read_record(files[archive], length)
                fields, _ = next(parts)
                page, kind, stated = fields["X-Page-ID"], fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                base = (int(page) if page else None, kind, int(fields["X-Refers-To-Page"]) if "X-Refers-To-Page" in fields else None)
                size, last, n = 0, None, 0
                for data, digest in parts:
                    if last is not None:
                        rows.append((*base, n, last[0], size, last[1], False))
                        held, n = held + len(last[0] or b""), n + 1
                    size += len(data)
                    last = (data if with_data else None, base32_sha1(digest))
                    if held > 8 << 20:
                        yield chunk_batch(rows)
                        rows, held = [], 0
                if kind == "revisit":
                    rows.append((*base, 0, None, int(fields["X-Payload-Length"]), stated, True))
                    continue
                if last[1] != stated or size != int(fields["X-Payload-Length"]):
                    raise ValueError(f"page {page}: the payload is not what its record states")
                rows.append((*base, n, last[0], size, last[1], True))
                held += len(last[0] or b"")
            if rows:
                yield chunk_batch(rows)
        for f in files.values():
            f.close()

    # Entries are small and what they point at is not: the number of tasks follows the archives' bytes.
    total = entries.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first()["b"]
    tasks = max(1, entries.sparkSession.sparkContext.defaultParallelism, -(-int(total) // READ_BYTES))
    parts = entries.select("archive", "offset", "length").repartition(tasks, "archive", F.floor(F.col("offset") / READ_BYTES))
    return parts.sortWithinPartitions("archive", "offset").mapInArrow(run, CHUNK_SCHEMA)


def chunk_batch(rows):
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_())
    names = ["page_id", "record_type", "refers_to", "chunk", "data", "payload_bytes", "digest", "last"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC and reads them back: a row a page with payload_bytes, payload_digest,
    record_type, refers_to. No page, no row; other columns are left aside."""
    folder = shared_folder(pages.sparkSession)
    entries = write_archives(chunked(plan_records(pages, least)), folder)
    chunks = read_chunks(entries, folder, with_data=False).where("last")
    return chunks.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
