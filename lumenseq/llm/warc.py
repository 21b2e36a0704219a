"""WARC archives: written by the tasks that hold the rows, read back record by record.

Each record is a gzip member of its own. A reader walks an archive from its start: it inflates step by step, takes the
record's header up to the empty line, then exactly ``Content-Length`` bytes, then the end of the member, and checks the block
and payload digests. Neither side holds more than one record and a fixed buffer.

Archives lie in a shared folder and are opened by its URI (any file system that pyarrow opens). A task writes under a name of
its own attempt and reports it; only reported archives are read, so attempts that were lost leave nothing behind in the result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenseq.llm.common import shared_path, shuffle_partitions

#: Compressed bytes after which a task begins a new archive, and bytes a reader asks for at a time.
ARCHIVE_BYTES, READ_BYTES = 64_000_000, 1 << 18
#: Copies of a digest group's row in the join: a group of any size is dealt over so many tasks.
SALTS = 16
DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, not yet compressed. A revisit carries the HTTP header and, in its own header, the payload's size and digest."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_uri(page_id)), ("WARC-Date", DATE),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", record_uri(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Inflater:
    """Plain bytes of one gzip member after another."""

    def __init__(self, source: BinaryIO, read_bytes: int = READ_BYTES):
        self.source, self.read_bytes, self.raw = source, read_bytes, b""

    def next_member(self) -> bool:
        """Start the next member; False at the archive's end."""
        self.engine, self.plain = zlib.decompressobj(31), bytearray()
        if not self.raw:
            self.raw = self.source.read(self.read_bytes)
        return bool(self.raw)

    def more(self) -> bool:
        """Inflate a bounded step; False at the member's end."""
        if self.engine.eof:
            return False
        self.raw = self.raw or self.source.read(self.read_bytes)
        if not self.raw:
            raise ValueError("archive ends inside a record")
        self.plain += self.engine.decompress(self.raw, self.read_bytes)
        self.raw = self.engine.unused_data if self.engine.eof else self.engine.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.plain.find(mark)) < 0:
            if not self.more():
                raise ValueError("record without a header")
        return self.exactly(at + len(mark))

    def exactly(self, n: int) -> bytes:
        while len(self.plain) < n:
            if not self.more():
                raise ValueError("record shorter than its Content-Length")
        out = bytes(self.plain[:n])
        del self.plain[:n]
        return out

    def finish(self) -> None:
        """The two line ends after the block, and nothing else."""
        while self.more():
            pass
        if self.plain != b"\r\n\r\n":
            raise ValueError("record longer than its Content-Length")


def read_records(source: BinaryIO, read_bytes: int = READ_BYTES) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """``(WARC fields, HTTP header, payload)`` of each record; raises where framing or a digest is wrong."""
    stream = Inflater(source, read_bytes)
    while stream.next_member():
        version, *lines = stream.until(b"\r\n\r\n").decode().rstrip("\r\n").split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines)
        block = stream.exactly(int(fields["Content-Length"]))
        stream.finish()
        if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"block digest differs in {fields['WARC-Record-ID']}")
        http, _, payload = block.partition(b"\r\n\r\n")
        if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha1:{base32_sha1(payload)}":
            raise ValueError(f"payload digest differs in {fields['WARC-Record-ID']}")
        yield fields, http, payload


def _page(uri: str) -> int | None:
    number = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def with_reference(pages: DataFrame, min_bytes: int, body: Column) -> DataFrame:
    """``page_id, url, html, refers_to``: of rows with equal payloads the largest page id is the response.

    Only groups of two or more are joined back, each over ``SALTS`` tasks.
    """
    rows = pages.select("page_id", "url", body.alias("html"))
    keyed = rows.withColumn("_digest", F.sha2(F.col("html").cast("binary"), 256))
    groups = (
        keyed.where(F.octet_length("html") >= min_bytes).groupBy("_digest")
        .agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
        .select("_digest", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    )
    salted = keyed.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(groups, ["_digest", "_salt"], "left")
    return joined.select("page_id", "url", "html", F.when(F.col("page_id") < F.col("_first"), F.col("_first")).cast("long").alias("refers_to"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``page_id, url, html, refers_to`` rows and return the committed archives as ``path, n_bytes, n_records``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pyarrow.fs.FileSystem.from_uri(folder)
        out, path, size, n = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "n_bytes": [size], "n_records": [n]})

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    path, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(path)
                data = member(record_bytes(page_id.as_py(), url.as_py(), html.as_py().encode(), refers_to.as_py()))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    spark = records.sparkSession
    listed = shared_path(spark, "warc-list")
    system, root = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    records.mapInArrow(write, "path string, n_bytes long, n_records long").write.parquet(listed)
    return spark.read.parquet(listed)


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to`` of every record in the archives.

    Archives are dealt evenly over a stated number of tasks: their list is a few bytes, which adaptive execution would
    otherwise gather into one task.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = pyarrow.fs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                with system.open_input_stream(path) as source:
                    for fields, http, payload in read_records(source):
                        kind = fields["WARC-Type"]
                        length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                        held.append((
                            _page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), payload if kind == "response" else None, length,
                            fields["WARC-Payload-Digest"].removeprefix("sha1:"), kind, _page(fields["WARC-Refers-To"]) if kind == "revisit" else None))
                        size += len(payload)
                        if size > 8_000_000 or len(held) >= 2_000:
                            yield batch_of(held)
                            held, size = [], 0
                if held:
                    yield batch_of(held)

    tasks = max(1, min(archives.count(), shuffle_partitions(archives.sparkSession)))
    spread = archives.select("path").repartition(tasks)
    return spread.mapInArrow(read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write a record for every row of ``pages``, read all archives back.

    A null html is the empty payload, and empty payloads revisit one another like others where ``min_bytes`` is 0. A null
    page_id is always a response and never referred to. Rows that repeat the largest page id of their payload are all
    responses. A null url has no target field; line ends in a url are percent-encoded. An empty table gives no rows. Other
    columns are not read.
    """
    folder = folder or shared_path(pages.sparkSession, "warc")
    body = F.coalesce(F.col("html"), F.lit(""))
    return read_archives(write_archives(with_reference(pages, min_bytes, body), folder), folder)
