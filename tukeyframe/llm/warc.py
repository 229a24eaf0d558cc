"""WARC archives: writing whole-file gzip, and a normaliser that gives every record its own gzip member and an index.

``normalise`` inflates each archive once, as a stream, whatever its layout (one member for the whole file, or many); it
rewrites every record as its own member and writes ``<archive>.idx`` beside it, a line of JSON a record: offset, length,
record id, type. Only one record at a time is held in memory. Archives go through pyarrow's file systems, so that a path
may be in any store that they know. The number of the attempt is part of a file's name, and only the names that a finished
attempt has returned are read on: an attempt that was lost, or runs a second time, leaves files that nobody reads and
never meets those of another.

Payloads stay in the input's partitions: only digests, sizes and ids are shuffled, and the groups of more than one page come
back by a broadcast, up to a stated number of them. Archives are cut by bytes.

Defined results: ids must be whole numbers; a null payload counts as empty; payloads of under ``min_bytes`` are always
responses; rows that repeat the winning id are all responses; rows with a null id never win, and are responses if no row of
their group has an id; an empty table gives no archive and an empty result; payloads of any length are written whole, one at
a time in memory; clashing column names don't matter, as only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tukeyframe.llm import scratch

BLOCK = 1 << 20
#: Payload bytes from which a task begins another archive, and archives (paths) that are partitions of their own at most.
ARCHIVE_BYTES, SPREAD = 1 << 28, 20_000
#: Rows of one payload from which they are dealt to several tasks, where groups are too many to be broadcast.
SALT_ROWS = 1000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The archives carry no clock time, so that a record is the same whenever it is written.
DATE = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    """Base32 of SHA-1, in upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP header (with the payload's length) and no payload."""
    http = HTTP.format(len(payload)).encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[5:5] = [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, in blocks."""
    member, data = zlib.decompressobj(31), b""
    while data or (data := stream.read(BLOCK)):
        if out := member.decompress(data, BLOCK):
            yield out
        data = member.unconsumed_tail or member.unused_data
        if member.eof:
            data = data.lstrip(b"\0")  # padding between members
            member = zlib.decompressobj(31)
    if out := member.flush():
        yield out


def headers(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def records(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The (headers, whole record) of each WARC record in a stream of bytes."""
    held, looked = bytearray(), 0
    blocks = iter(blocks)

    def more() -> bool:
        got = next(blocks, None)
        held.extend(got or b"")
        return got is not None

    while True:
        while (end := held.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(held)
            if not more():
                if held.strip(b"\r\n"):
                    raise ValueError("the archive ends within a record's header")
                return
        found = headers(bytes(held[:end]))
        size = end + 4 + int(found["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("the archive ends within a record")
        yield found, bytes(held[:size])
        del held[:size]
        looked = 0


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class _Placed:
    """A file of this attempt: deleted again if writing it fails."""

    def __init__(self, path: str):
        self.files, self.path = _place(path)

    def __enter__(self):
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.files.open_output_stream(self.path, compression=None)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is not None:
            self.files.delete_file(self.path)


def _attempt() -> int:
    """A number that no other attempt of a task of this application has."""
    task = TaskContext.get()
    return task.taskAttemptId() if task else 0


def verdicts(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", min_bytes: int = 0, groups: int = scratch.BROADCAST_ROWS) -> DataFrame:
    """Each page with the record that it becomes: key, url, payload (binary), revisit, refers_to.

    Groups are formed on digest and size, with the largest id combined on the map side. What comes back to the pages are the
    groups of more than one: broadcast if there are at most that many groups; beyond that the pages are shuffled, those of
    a large group by a salt, so that no task gets a group whole.
    """
    data = pages.select(
        F.col(key).cast("long").alias("key"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.encode(F.col(payload).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumns({"digest": F.unhex(F.sha1("payload")), "size": F.length("payload")})
    repeated = data.groupBy("digest", "size").agg(F.max("key").alias("winner"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = scratch.materialise(repeated, "repeated-payloads")
    if repeated.count() <= groups:
        joined = data.join(F.broadcast(repeated.drop("n")), ["digest", "size"], "left")
    else:
        salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
        hot = scratch.materialise(repeated.where(F.col("n") > SALT_ROWS).select("digest", "size", salts.alias("salts")), "hot-payloads")
        rows = data.withColumn("row", F.monotonically_increasing_id()).join(scratch.small(hot), ["digest", "size"], "left")
        rows = rows.withColumn("salt", F.pmod(F.col("row"), F.coalesce("salts", F.lit(1))).cast("int"))
        dealt = repeated.select("digest", "size", "winner", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        joined = rows.join(dealt, ["digest", "size", "salt"], "left")
    revisit = F.coalesce((F.col("size") >= min_bytes) & F.col("winner").isNotNull() & ~F.col("key").eqNullSafe(F.col("winner")), F.lit(False))
    return joined.select("key", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("winner")).alias("refers_to"))


def write_monolithic(rows: DataFrame, folder: str, level: int = 1, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes each partition of verdicts() as WARC files of one gzip member each; the paths, a row a file.

    A file takes records until its payloads come to archive_bytes. level is the compression level: these files are only
    read once.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, name = _rows(batches), f"{folder}/part-{TaskContext.get().partitionId():06d}-{_attempt()}"
        row, n = next(rows, None), 0
        while row is not None:
            path, packer, size = f"{name}-{n:04d}.warc.gz", zlib.compressobj(level, zlib.DEFLATED, 31), 0
            with _Placed(path) as out:
                while row is not None and size < archive_bytes:
                    out.write(packer.compress(record(*row)))
                    size += len(row[2])
                    row = next(rows, None)
                out.write(packer.flush())
            n += 1
            yield pa.RecordBatch.from_pydict({"path": [path]})

    return scratch.text_batches(rows.select("key", "url", "payload", "refers_to", "revisit")).mapInArrow(write, "path string")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows, one at a time as Python objects."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def normalise(archives: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Rewrites each archive (column path) into folder with a gzip member a record, and its sidecar index.

    Returns a row an archive: path of the new archive, path of its index, records.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path,) in _rows(batches):
            target, n, at = f"{folder}/{path.rpartition('/')[2].removesuffix('.warc.gz')}-{_attempt()}.warc.gz", 0, 0
            files, name = _place(path)
            with files.open_input_stream(name, compression=None) as stream, _Placed(target) as out, _Placed(f"{target}.idx") as index:
                for found, whole in records(inflated(stream)):
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = packer.compress(whole) + packer.flush()
                    out.write(member)
                    line = {"offset": at, "length": len(member), "id": found.get("warc-record-id"), "type": found.get("warc-type")}
                    index.write(json.dumps(line).encode() + b"\n")
                    n, at = n + 1, at + len(member)
            yield pa.RecordBatch.from_pydict({"path": [target], "index": [f"{target}.idx"], "records": [n]})

    return archives.select("path").mapInArrow(rewrite, "path string, index string, records long")


#: What read() returns.
RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("archive", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
    ]
)


def read(archives: DataFrame, rows_at_once: int = 4096) -> DataFrame:
    """Reads normalised archives (columns path, index) by their indexes: a row a record, each member inflated by itself.

    The digest of a response is computed again from its payload and must be the stated one.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RECORD, strict=True)], schema=RECORD)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, index in _rows(batches):
            files, name = _place(path)
            _, index_name = _place(index)
            with files.open_input_file(name) as data, files.open_input_stream(index_name, compression=None) as lines:
                rows = []
                for line in _lines(lines):
                    entry = json.loads(line)
                    data.seek(entry["offset"])
                    ((found, whole),) = records(iter([zlib.decompress(data.read(entry["length"]), 31)]))
                    rows.append(_row(found, whole, path, entry))
                    if len(rows) == rows_at_once:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return archives.select("path", "index").mapInArrow(look, schema)


def _lines(stream) -> Iterator[bytes]:
    held = b""
    while data := stream.read(BLOCK):
        *whole, held = (held + data).split(b"\n")
        yield from whole
    if held:
        yield held


def _key(text: str | None) -> int | None:
    digits = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _row(found: dict[str, str], whole: bytes, path: str, entry: dict) -> tuple:
    start = whole.index(b"\r\n\r\n") + 4
    block = whole[start : start + int(found["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size, stated = int(headers(http)["content-length"]), found["warc-payload-digest"].removeprefix("sha1:")
    if found["warc-type"] == "response" and (len(payload) != size or payload_digest(payload) != stated):
        raise ValueError(f"{path} at {entry['offset']}: the payload doesn't match its digest")
    return _key(found["warc-record-id"]), size, stated, found["warc-type"], _key(found.get("warc-refers-to")), path, entry["offset"], entry["length"]


def round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes pages as whole-file gzip archives, normalises them, and returns what read() finds in the result."""
    spark: SparkSession = pages.sparkSession
    folder = folder or scratch.new_path(spark, "warc")
    written = scratch.materialise(write_monolithic(verdicts(pages, min_bytes=min_bytes), f"{folder}/whole"), "warc-paths")
    rewritten = scratch.materialise(normalise(_spread(written), f"{folder}/members"), "warc-members")
    return read(_spread(rewritten))


def _spread(paths: DataFrame) -> DataFrame:
    """A partition a path, in ranges of paths from SPREAD on: each row stands for an archive's worth of work."""
    return paths.repartitionByRange(max(1, min(SPREAD, paths.count())), "path")
