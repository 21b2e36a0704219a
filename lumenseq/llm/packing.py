"""Cost-balanced packing of token documents into sequences.

A task packs its own documents, pool by pool; nothing is shuffled and no pool holds more than ``POOL_TOKENS`` tokens and
one document. Whole sequences are cut from long documents first. The rest of a pool goes, longest first, to the sequence
that costs least so far among those with room, where a piece of n tokens costs ``linear * n + quadratic * n * n`` (the
dense layers and the attention inside one document). A piece that fits nowhere is cut. What is left of a pool after its
full sequences becomes sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lumenseq.llm import word_bpe as W
from lumenseq.llm.common import texts_in_slices, whole

POOL_TOKENS = 1_000_000
#: Fixed value: the id that ends a document.
END = 1
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def capacities(tokens: int, size: int) -> list[int]:
    """Full sequences, then the powers of two that make up the rest."""
    rest = tokens % size
    return [size] * (tokens // size) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: list[int], size: int, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> list[tuple[int, int, int, int, int]]:
    """``(document, start, length, sequence, offset)`` for documents of these lengths in a pool of their own."""
    rooms = np.array(capacities(sum(lengths), size), dtype="i8")
    left, cost = rooms.copy(), np.zeros(len(rooms))
    out, todo, sequence = [], [], 0
    for i, n in enumerate(lengths):  # whole sequences first
        start = 0
        while n - start >= size:
            out.append((i, start, size, sequence, 0))
            left[sequence] = 0
            sequence += 1
            start += size
        if n > start:
            todo.append((n - start, i, start))
    todo.sort(key=lambda x: (-x[0], x[1]))
    for n, i, start in todo:
        while n:
            fits = np.flatnonzero(left >= n)
            at = int(fits[np.argmin(cost[fits])]) if len(fits) else int(np.argmax(left))
            part = min(n, int(left[at]))
            out.append((i, start, part, at, int(rooms[at] - left[at])))
            left[at] -= part
            cost[at] += linear * part + quadratic * part * part
            n, start = n - part, start + part
    return out


def pack(docs: DataFrame, size: int = 2048, path: str | None = None, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text is the document that holds the end id alone; repeated rows are documents of their own; a text
    longer than a pool is cut like any other; an empty table gives no rows; other columns are not read. Sequence ids are
    unique, not dense: the partition, then the number inside it. ``size`` is a power of two.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    path = path or W.default_path()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = W.worker_cache(path)
        sequence = TaskContext.get().partitionId() << 40
        ids: list[np.ndarray] = []
        names: list = []

        def flush() -> pa.RecordBatch:
            nonlocal sequence, ids, names
            rows = assign([len(x) for x in ids], size, linear, quadratic)
            columns = [
                pa.array([names[i] for i, *_ in rows], batch.schema.field("doc_id").type),
                [s for _, s, *_ in rows], [n for _, _, n, *_ in rows],
                [zlib.crc32(ids[i][s : s + n].astype("<u4").tobytes()) for i, s, n, *_ in rows],
                [len(ids[i]) for i, *_ in rows], [sequence + q for *_, q, _ in rows], [o for *_, o in rows],
            ]
            sequence += max((q for *_, q, _ in rows), default=-1) + 1
            ids, names = [], []
            return pa.RecordBatch.from_arrays(
                [columns[0], *(pa.array(c, pa.int64()) for c in columns[1:])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

        held = 0
        for batch in batches:
            for first, texts in texts_in_slices(batch):
                for k, found in enumerate(cache.encode(texts)):
                    ids.append(np.append(found, np.uint32(END)))
                    names.append(batch.column("doc_id")[first + k].as_py())
                    held += len(ids[-1])
                if held >= POOL_TOKENS:
                    yield flush()
                    held = 0
        if ids:
            yield flush()

    return docs.select("doc_id", whole().alias("text")).mapInArrow(run, f"doc_id {id_type}, {SCHEMA}")
