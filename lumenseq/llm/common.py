"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseq.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new name in the folder that driver and executors share."""
    return scratch_path(spark, kind)


def whole(text: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def row_key() -> Column:
    """Orders rows by id, nulls last, then by hash of the text; equal only where both are."""
    return F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.xxhash64(whole()).alias("text_hash"))


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bucket_count(texts: DataFrame, bytes_each: int, column: str = "text") -> int:
    """Buckets of about ``bytes_each`` bytes of text, and no fewer than the session's shuffle partitions.

    One scan of the whole column; only the sum comes to the driver.
    """
    total = texts.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(shuffle_partitions(texts.sparkSession), -(-int(total) // bytes_each))


def hash_bucket(n: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def hot_lookup(rows: DataFrame, known: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """Inner join of ``rows`` with ``known``, whose ``keys`` are unique.

    ``hot`` marks the entries of ``known`` that many rows may ask for; the caller gives a proof that they are few. They are
    broadcast, so that rows with a hot key stay where they are; the other rows meet their entry by shuffle.
    """
    few = F.broadcast(known.where(hot))
    return rows.join(few, keys).unionByName(rows.join(few.select(*keys), keys, "left_anti").join(known.where(~F.coalesce(hot, F.lit(False))), keys))


def texts_in_slices(batch: pa.RecordBatch, column: str = "text", chars: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """``(first row, texts)`` for runs of rows of about ``chars`` characters, so that Python objects stay few."""
    start, held, size = 0, [], 0
    for i, text in enumerate(batch.column(column)):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= chars:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def squeeze(array: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(array).tobytes(), 1)


def unsqueeze(data: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=dtype)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys as compressed steps, byte plane by byte plane."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(steps.view("u1").reshape(-1, 8).T).tobytes(), 1)


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype="u1").reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype="u8")


def pack_rows(df: DataFrame, bucket: str = "bucket", flush_bytes: int = 24_000_000) -> DataFrame:
    """Rows of a bucket as compressed Arrow blobs ``(bucket, rows)``: a text shuffle of a third of the size.

    A task holds at most about ``flush_bytes`` before it hands its blobs on.
    """
    inner = [c for c in df.columns if c != bucket]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blobs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            ids = rows.column(bucket).to_numpy()
            order = np.argsort(ids, kind="stable")
            cuts = np.flatnonzero(np.diff(ids[order], prepend=-1)) if len(ids) else np.array([], dtype=int)
            keys, data = [], []
            for first, last in zip(cuts, [*cuts[1:], len(ids)], strict=True):
                part = rows.select(inner).take(pa.array(order[first:last])).combine_chunks()
                sink = io.BytesIO()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(part)
                keys.append(int(ids[order[first]]))
                data.append(sink.getvalue())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], [bucket, "rows"])

        held, size = [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                held.append(batch.slice(first, 500))
                size += held[-1].nbytes
                if size >= flush_bytes:
                    yield blobs(held)
                    held, size = [], 0
        if held:
            yield blobs(held)

    return df.mapInArrow(pack, f"{bucket} int, rows binary")


def unpack_rows(blobs) -> pa.Table:
    """The rows of several blobs of one bucket."""
    return pa.concat_tables([pa.ipc.open_stream(blob.as_py()).read_all() for blob in blobs])
