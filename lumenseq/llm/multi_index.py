"""Approximate nearest neighbours by inner product with an inverted multi-index.

Each half of the vectors is quantised with a codebook of its own; a pair of centroids is a cell. A query takes cells in
order of the summed distances of its halves to the two centroids (distance: the negative inner product), by a heap over the
two sorted lists, until the cells it has taken hold a share of all rows. All rows of those cells, and no others, are ranked
by their scores on the original vectors. Every row is in exactly one cell.

The codebooks and the share are fitted on a bounded sample: the share is the one at which ``recall`` of the true neighbours
inside the sample are in cells taken. Vectors in clusters need a small share; for vectors without any structure, such as
independent random ones, no index saves much, and the share and the work grow accordingly.

Cells are gathered into blocks of about ``BLOCK_ROWS`` rows, and a cell with more is cut into several. The table of cells has
at most ``MOST_CENTROIDS ** 2`` rows and is the only thing that every task gets.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenseq.llm.common import shuffle_partitions
from lumenseq.session import cut_lineage

#: Rows and queries of the sample that codebooks and share are fitted on; rows a cell has on average until there are most
#: centroids; rows and queries of a block.
FIT_ROWS, FIT_QUERIES, CELL_ROWS, BLOCK_ROWS, BLOCK_QUERIES, MOST_CENTROIDS = 16_384, 256, 16, 4_096, 1_024, 512
#: Queries that one task traverses the index for, about.
QUERIES_EACH = 256
_INF = float("inf")


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(_INF)))
    return F.coalesce(vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def codebook(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centroids of ``rows`` by Lloyd's method."""
    centres = rows[rng.choice(len(rows), size=min(k, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(rows, centres)
        size = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([
        np.argmin((centres**2).sum(axis=1) - 2 * rows[i : i + 8_192] @ centres.T, axis=1) for i in range(0, len(rows), 8_192)
    ] or [np.zeros(0, int)])


def cells_by_distance(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of centroids, the least summed distance first."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, met = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in met:
                met.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype="f8").reshape(-1, dim)


def share_needed(fit: np.ndarray, books: list[np.ndarray], half: int, k: int, recall: float, rng: np.random.Generator) -> float:
    """Share of the rows whose cells come first, for that recall inside the sample."""
    asked = rng.choice(len(fit), size=min(FIT_QUERIES, len(fit)), replace=False)
    cells = [nearest(fit[:, :half], books[0]), nearest(fit[:, half:], books[1])]
    places = []
    for i in asked:
        score = fit @ fit[i]
        score[i] = -_INF
        true = np.argsort(-score, kind="stable")[: min(k, len(fit) - 1)]
        distance = -(books[0] @ fit[i, :half])[cells[0]] - (books[1] @ fit[i, half:])[cells[1]]
        places.append(np.searchsorted(np.sort(distance), distance[true], side="right"))
    found = np.concatenate(places)
    return float(np.quantile(found, recall)) / len(fit) if len(found) else 1.0


def best_of(
    queries: np.ndarray, query_ids: np.ndarray, taken: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, row_cells: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query number, row number, score)`` of each query's ``k`` best rows in cells that it took, ties to the smaller id.

    ``taken`` has a line of cells for each query. Products are added component by component, so equal vectors have equal
    scores wherever they stand.
    """
    order = np.argsort(row_ids, kind="stable")
    rows_t, ids, cells = np.ascontiguousarray(rows[order].T), row_ids[order], row_cells[order]
    out_q, out_r, out_s = [], [], []
    for start in range(0, len(queries), 64):
        part = queries[start : start + 64]
        score = np.zeros((len(part), rows_t.shape[1]))
        for d in range(rows_t.shape[0]):
            score += part[:, d, None] * rows_t[d]
        score[(query_ids[start : start + 64, None] == ids) | ~taken[start : start + 64][:, cells]] = -_INF
        for i, line in enumerate(score):
            if len(line) > k:
                able = np.flatnonzero(line >= np.partition(line, len(line) - k)[len(line) - k])
            else:
                able = np.arange(len(line))
            able = able[np.argsort(-line[able], kind="stable")][:k]
            able = able[line[able] > -_INF]
            out_q.append(np.full(len(able), start + i))
            out_r.append(order[able])
            out_s.append(line[able])
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(out_q, int), join(out_r, int), join(out_s, float)


def search(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.95, seed: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``is_query`` its ``k`` nearest found among all other rows.

    ``vectors`` has ``vec_id`` and ``embedding``. Vectors that are null, zero or hold a null or non-finite component take no
    part, nor do those whose length isn't the most frequent one, nor null ids. Rows with the query's id are its own and left
    out; a repeated query row is searched once; equal rows under other ids are candidates each, and tie by id. Where fewer
    than ``k`` others exist, all are returned; an empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), is_query.alias("q")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    shape = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = shape.dim, shape.n
    half = max(dim // 2, 1)
    rows = rows.where(F.size("v") == dim)
    drawn = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, FIT_ROWS / n) * (1 << 30)) + 1
    sample = rows.where(drawn).select("vec_id", "v").collect()
    fit = np.array([r.v for r in sorted(sample, key=lambda r: (r.vec_id, r.v))]).reshape(-1, dim)
    if not len(fit):  # a few rows, all out of the draw
        fit = np.array([rows.first().v])
    rng = np.random.default_rng(seed)
    k_half = int(min(MOST_CENTROIDS, max(2, math.ceil(math.sqrt(n / CELL_ROWS)))))
    books = [codebook(fit[:, :half], k_half, rng), codebook(fit[:, half:], k_half, rng) if dim > 1 else np.zeros((1, 0))]
    width = len(books[1])
    budget = max(2 * k, math.ceil(share_needed(fit, books, half, k, recall, rng) * n))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column("v"), dim)
            cell = nearest(m[:, :half], books[0]) * width + nearest(m[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])

    indexed = cut_lineage(rows.mapInArrow(assign, "vec_id long, v array<double>, q boolean, cell int"))
    size = np.zeros(len(books[0]) * width, "i8")
    for r in indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # MOST_CENTROIDS ** 2 at most
        size[r.cell] = r.n
    pieces = np.maximum(-(-size // BLOCK_ROWS), 1)  # blocks of a cell of its own
    small = size <= BLOCK_ROWS
    first = np.where(small, np.cumsum(np.where(small, size, 0)) // BLOCK_ROWS, 0)  # cells in order share blocks
    first[~small] = first.max(initial=0) + 1 + np.cumsum(pieces[~small]) - pieces[~small]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                m = matrix(some.column("v"), dim)
                near, far = -m[:, :half] @ books[0].T, -m[:, half:] @ books[1].T
                at, blocks, cells = [], [], []
                for i in range(len(m)):
                    held, mine = 0, []
                    for a, b in cells_by_distance(near[i], far[i]):
                        if size[a * width + b]:
                            mine.append(a * width + b)
                            held += size[mine[-1]]
                            if held > budget:
                                break
                    by_block: dict[int, list[int]] = {}
                    for c in mine:
                        for p in range(pieces[c]):
                            by_block.setdefault(int(first[c]) + p, []).append(c)
                    at += [i] * len(by_block)
                    blocks += by_block.keys()
                    cells += by_block.values()
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [some.column("vec_id").take(at), some.column("v").take(at), pa.array(blocks, pa.int64()), pa.array(cells, pa.list_(pa.int32()))],
                    ["vec_id", "v", "block", "cells"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            block = first[cell] + batch.column("mix").to_numpy() % pieces[cell]
            yield pa.RecordBatch.from_arrays([*batch.select(["vec_id", "v", "cell"]).columns, pa.array(block, pa.int64())], ["vec_id", "v", "cell", "block"])

    mix = F.pmod(F.xxhash64("vec_id", F.lit(seed + 1)), F.lit(1 << 40))
    asked = indexed.where("q").select("vec_id", "v")
    deals = max(shuffle_partitions(vectors.sparkSession), -(-asked.count() // QUERIES_EACH))  # a stated number: narrow rows would be coalesced into one task
    asked = asked.repartition(deals, "vec_id").dropDuplicates()
    probes = cut_lineage(asked.mapInArrow(probe, "vec_id long, v array<double>, block long, cells array<int>"))
    columns = probes.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("cols"))
    left = probes.join(columns, "block").select("block", F.pmod(mix, F.col("cols")).cast("int").alias("col"), "vec_id", "v", "cells")
    dealt = indexed.select("vec_id", "v", "cell", mix.alias("mix")).mapInArrow(deal, "vec_id long, v array<double>, cell int, block long")
    right = dealt.join(columns, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"), "vec_id", "v", "cell")

    def score(queries: pa.Table, entries: pa.Table) -> pa.Table:
        qid, vid = queries.column("vec_id").to_numpy(), entries.column("vec_id").to_numpy()
        q, r, s = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        mark = np.zeros(0, "i8")
        if len(qid) and len(vid):
            vectors_ = matrix(queries.column("v"), dim)
            names, cell = np.unique(entries.column("cell").to_numpy(), return_inverse=True)
            taken = np.zeros((len(qid), len(names)), bool)
            for i, mine in enumerate(queries.column("cells").to_pylist()):
                taken[i] = np.isin(names, mine)
            q, r, s = best_of(vectors_, qid, taken, matrix(entries.column("v"), dim), vid, cell, k)
            mark = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in vectors_], dtype="u8").view("i8")
        return pa.table({"query_id": pa.array(qid[q], pa.int64()), "mark": pa.array(mark[q], pa.int64()), "vec_id": pa.array(vid[r], pa.int64()), "score": pa.array(s, pa.float64())})

    found = left.groupBy("block", "col").cogroup(right.groupBy("block", "col")).applyInArrow(score, "query_id long, mark long, vec_id long, score double")
    best = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
