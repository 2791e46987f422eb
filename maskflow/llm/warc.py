"""Seekable Zstandard bundles of WARC records.

A bundle is a file ``<bundle>.warc.zst`` in the shared folder: independent Zstandard
frames, each holding a few whole records, then a skippable frame with the seek table
of Zstandard's seekable format (compressed and decompressed size of every frame).
Records are WARC/1.1: every bundle begins with a ``warcinfo`` record, every record has
its identifier, date, target and digest, and a ``revisit`` names the record that it
repeats.  An index table maps a record identifier to its bundle, its frame, and its
place within the frame's content.  Identifiers are hashes, and the index has a folder for
each of their beginnings, so a look-up reads the files of one folder.  A record is read
by its bundle's seek table and the bytes of one frame.

A bundle's name has the attempt that wrote it and the index comes from the attempt
that Spark commits, so a task that runs again leaves at most files that no index
row names.

Payloads that equal an earlier page's are written as ``revisit`` records without
a body.  Spark finds the equal ones by digest: the smallest page_id of a digest
comes from a partial aggregate, so thousands of copies shuffle as one row for
each task.  Only digests of several pages are joined back to the pages: broadcast
while they are few, so payloads stay where they are, else by a join that adaptive
execution splits where a digest is hot.

Defined results: a null html is an empty payload; a null url is the target ``about:blank``;
a null page_id comes after all others and, as the smallest of its digest, makes a
response; rows that repeat the smallest page_id of a digest are responses
as well, under one identifier, as it is one record; an empty table makes no bundle; other
columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import struct
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskflow.llm.arraystore import Objects
from maskflow.llm.shared import scratch, sized_join, stored

# Fixed values of Zstandard's seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CRLF = b"\r\n"


@dataclass(frozen=True)
class BundleParams:
    """Payloads of fewer bytes than ``least_bytes`` are always responses."""

    least_bytes: int = 0
    frame_bytes: int = 256 << 10
    bundle_bytes: int = 8 << 20
    level: int = 3
    #: of every record, as the table has none
    date: str = "2000-01-01T00:00:00Z"


INDEX = "record_id string, bundle string, frame int, offset bigint, length bigint"
SOFTWARE = "maskflow"
#: Folders of the index at most, as digits of an identifier.
MOST_DIGITS = 3
NO_TARGET = "about:blank"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def identifier(page_id: int | None, sha: str, place: str = "") -> str:
    """The identifier of a page's record; a response's follows from the page alone, so that others can name it."""
    return str(uuid.uuid5(uuid.NAMESPACE_OID, f"{SOFTWARE}:{page_id}:{sha}:{place}"))


def written(head: list[tuple[str, str]], body: bytes) -> bytes:
    head = [*head, ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + CRLF + body + CRLF + CRLF


def info_bytes(bundle: str, params: BundleParams) -> bytes:
    """The record that describes a bundle, which is its first."""
    head = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", f"<urn:uuid:{identifier(None, '', bundle)}>"),
        ("WARC-Date", params.date),
        ("WARC-Filename", f"{bundle}.warc.zst"),
        ("Content-Type", "application/warc-fields"),
    ]
    return written(head, f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\n".encode())


def record_bytes(row: dict, record_id: str, params: BundleParams = BundleParams()) -> bytes:
    """One WARC/1.1 record; a revisit has no body and names the record that it repeats."""
    target = (row["url"] or NO_TARGET).replace("\r", "%0D").replace("\n", "%0A")
    head = [
        ("WARC-Type", row["kind"]),
        ("WARC-Record-ID", f"<urn:uuid:{record_id}>"),
        ("WARC-Date", params.date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["sha"])).decode()),
        ("X-Payload-Length", str(row["n_bytes"])),
        ("X-Page-Id", "" if row["page_id"] is None else str(row["page_id"])),
    ]
    if row["kind"] == "revisit":
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:uuid:{identifier(row['refers_to'], row['sha'])}>"),
            ("X-Refers-To-Page-Id", str(row["refers_to"])),
        ]
    return written([*head, ("Content-Type", "text/html; charset=utf-8")], row["payload"])


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, body, end) of the record that begins at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    n = int(head["Content-Length"])
    return head, data[end + 4 : end + 4 + n], end + 4 + n + 4


class BundleWriter:
    """Collects records into frames; :meth:`finish` gives the archive and its index."""

    def __init__(self, params: BundleParams):
        import zstandard

        self.params, self.compressor = params, zstandard.ZstdCompressor(level=params.level)
        self.clear()

    def clear(self) -> None:
        self.frames: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.entries: list[dict] = []
        self.open: list[bytes] = []
        self.held = self.total = 0

    def add(self, record_id: str, record: bytes) -> None:
        self.entries.append({"record_id": record_id, "frame": len(self.frames), "offset": self.held, "length": len(record)})
        self.open.append(record)
        self.held += len(record)
        if self.held >= self.params.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.open:
            packed = self.compressor.compress(b"".join(self.open))
            self.frames.append((len(packed), self.held))
            self.parts.append(packed)
            self.total += len(packed)
            self.open, self.held = [], 0

    def full(self) -> bool:
        return self.total >= self.params.bundle_bytes

    def finish(self) -> tuple[bytes, list[dict]]:
        self._close_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        archive = b"".join(self.parts) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table
        entries = self.entries
        self.clear()
        return archive, entries


class BundleReader:
    """Reads single frames of an open bundle by its seek table."""

    def __init__(self, file):
        import io
        import zstandard

        self.file, self.decompressor = file, zstandard.ZstdDecompressor()
        size = file.seek(0, io.SEEK_END) or file.tell()
        n, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags:
            raise ValueError("no seek table")
        table = self._read(size - 17 - 8 * n, 8 * n + 8)
        if struct.unpack_from("<II", table) != (SKIPPABLE_MAGIC, 8 * n + 9):
            raise ValueError("no seek table")
        self.frames, begin = [], 0
        for k in range(1, n + 1):
            packed, content = struct.unpack_from("<II", table, 8 * k)
            self.frames.append((begin, packed, content))
            begin += packed

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        begin, packed, size = self.frames[k]
        return self.decompressor.decompress(self._read(begin, packed), max_output_size=max(size, 1))

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def _decided(pages: DataFrame, params: BundleParams) -> DataFrame:
    """(page_id, url, html as bytes, kind, refers_to)."""
    df = pages.select("page_id", "url", F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("payload"))
    df = df.withColumn("sha", F.sha1("payload"))
    # the smallest page_id; a null one only if there is no other
    first = stored(df.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies"), "repeated-payloads")
    joined = sized_join(df, first, "sha", "left")
    repeats = (
        (F.length("payload") >= params.least_bytes)
        & F.col("first_id").isNotNull()
        & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    )
    return joined.select(
        "page_id",
        "url",
        F.when(repeats, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
        F.when(repeats, "revisit").otherwise("response").alias("kind"),
        F.when(repeats, F.col("first_id")).alias("refers_to"),
        "sha",
        F.length("payload").cast("bigint").alias("n_bytes"),
    )


def write_bundles(pages: DataFrame, params: BundleParams = BundleParams(), path: str | None = None) -> str:
    """Write all pages; returns the folder, with ``bundles`` (files) and ``index`` (a Parquet table) below it."""
    path = (path or scratch(pages.sparkSession, "warc")).rstrip("/")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        writer, objects, n, number = BundleWriter(params), Objects(f"{path}/bundles"), 0, 0
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        name = ""

        def begin():
            nonlocal name
            name = f"{part:06d}-{attempt}-{number:05d}"
            writer.add("", info_bytes(name, params))

        def bundle():
            nonlocal number
            archive, entries = writer.finish()
            entries = entries[1:]  # all but the description
            number += 1
            objects.put(f"{name}.warc.zst", archive)
            columns = [pa.array([e[c] for e in entries], t) for c, t in (("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()))]
            return pa.RecordBatch.from_arrays([columns[0], pa.array([name] * len(entries)), *columns[1:]], names=["record_id", "bundle", "frame", "offset", "length"])

        for batch in batches:
            for row in batch.to_pylist():
                # a revisit's digest and length are those of the payload that it repeats
                own = row["kind"] == "response" and row["page_id"] is not None
                record_id = identifier(row["page_id"], row["sha"], "" if own else f"{part}-{n}")
                n += 1
                if not writer.entries:
                    begin()
                writer.add(record_id, record_bytes(row, record_id, params))
                if writer.full():
                    yield bundle()
        if writer.entries:
            yield bundle()

    index = _decided(pages, params).mapInArrow(run, INDEX)
    # as many folders as there are parts of the input, about
    digits = min(MOST_DIGITS, max(1, math.ceil(math.log(max(pages.rdd.getNumPartitions(), 1), 16))))
    index.withColumn("prefix", F.left("record_id", F.lit(digits))).repartition("prefix").write.partitionBy("prefix").parquet(f"{path}/index")
    return path


def read_index(spark, path: str) -> DataFrame:
    return spark.read.schema(f"{INDEX}, prefix string").parquet(f"{path}/index")


RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("bundle", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("frame", T.IntegerType()),
        T.StructField("offset", T.LongType()),
    ]
)


def read_records(spark, path: str) -> DataFrame:
    """Every record that the index names, read from its frame; bodies are checked against their digests."""

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        objects, schema = Objects(f"{path}/bundles"), to_arrow_schema(RECORDS)
        name, reader, at, data = None, None, -1, b""
        for batch in batches:
            out = []
            for e in batch.to_pylist():
                if e["bundle"] != name:
                    if reader:
                        reader.file.close()
                    name, at = e["bundle"], -1
                    reader = BundleReader(objects.open(f"{name}.warc.zst"))
                if e["frame"] != at:
                    at, data = e["frame"], reader.frame(e["frame"])
                head, body, end = parse_record(data, e["offset"])
                if end != e["offset"] + e["length"] or not head["WARC-Record-ID"].endswith(f"{e['record_id']}>"):
                    raise ValueError(f"index and record differ: {name}, {e['record_id']}")
                sha = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] == "response" and (digest(body) != sha or len(body) != int(head["X-Payload-Length"])):
                    raise ValueError(f"payload and digest differ: {name}, {e['record_id']}")
                out.append(
                    {
                        "page_id": int(head["X-Page-Id"]) if head["X-Page-Id"] else None,
                        "payload_bytes": int(head["X-Payload-Length"]),
                        "payload_digest": sha,
                        "record_type": head["WARC-Type"],
                        "refers_to": int(head["X-Refers-To-Page-Id"]) if "X-Refers-To-Page-Id" in head else None,
                        "url": "" if head["WARC-Target-URI"] == NO_TARGET else head["WARC-Target-URI"],
                        "bundle": name,
                        "record_id": e["record_id"],
                        "frame": e["frame"],
                        "offset": e["offset"],
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if reader:
            reader.file.close()

    # a bundle's records together and in order: only rows of the index travel
    by_place = read_index(spark, path).drop("prefix").repartition("bundle").sortWithinPartitions("bundle", "frame", "offset")
    return by_place.mapInArrow(run, RECORDS)


def fetch(spark, path: str, record_id: str) -> bytes | None:
    """One record's bytes: a row from one folder of the index, a seek table, one frame."""
    found = read_index(spark, path).filter(F.lit(record_id).startswith(F.col("prefix")) & (F.col("record_id") == record_id)).limit(1).collect()
    for e in found:
        with Objects(f"{path}/bundles").open(f"{e['bundle']}.warc.zst") as file:
            return BundleReader(file).record(e["frame"], e["offset"], e["length"])
    return None
