"""Product codes of vectors: integer codebooks, refined in rounds, and nearest entries found in a tree.

A vector is read as whole numbers and cut into equal consecutive parts; each part is replaced by the number of the nearest
entry of its position's codebook. Codebooks are small (``entries`` a part), so they travel to every task; a round brings back
only counts and sums of an entry's parts, added up by tasks first.

The nearest entry is searched in a GNAT, a tree over the entries: a node has a few split points, every other entry belongs to
the nearest of them, and for each pair the node keeps the range of distances from one split point to all that belongs to the
other. A part's distance to a split point then rules out subtrees whose range lies wholly beyond the best distance so far.
Roots are floating point, so a subtree goes only where it is farther by more than their error could be; equal distances
always stay, and squared distances in whole numbers decide between what is left, ties by the lower number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenseq.llm.common import hot_lookup
from lumenseq.session import cut_lineage

#: Split points of a node, rows of a batch handled at once, groups that add up the tasks' sums.
SPLITS, ROWS, ADDERS = 4, 4096, 32
#: Fixed value: what a component is multiplied by.
SCALE = 4096.0
#: Share of a distance that covers the rounding of roots and sums.
SLACK = 1e-9


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)``, as Python integers where 64 bits could overflow in a squared distance."""
    with np.errstate(over="ignore"):
        down = np.floor(values * SCALE)
    if not down.size or np.abs(down).max() < 2.0**25:
        return down.astype("i8")
    return np.array([int(np.floor(x * SCALE)) if np.isfinite(x * SCALE) else int(x) * int(SCALE) for x in values.ravel()], dtype=object).reshape(values.shape)


def cut_points(length: int, parts: int) -> list[int]:
    """Equal parts where the length allows it, else parts whose lengths differ by one."""
    return [p * length // parts for p in range(parts + 1)]


def squared(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each point, in whole numbers."""
    step = rows[:, None, :] - points[None, :, :]
    if step.dtype == object or rows.shape[1] * 2.0**52 >= 2.0**63:  # long parts: Python integers
        step = step.astype(object)
    return (step * step).sum(axis=2)


def roots(squares: np.ndarray) -> np.ndarray:
    """Distances; infinite, so that they rule nothing out, where a double could not hold the square."""
    if squares.dtype == object:
        squares = np.array([float(x) if x < 1 << 1000 else np.inf for x in squares.ravel()]).reshape(squares.shape)
    return np.sqrt(squares.astype("f8"))


@dataclass
class Node:
    """``low[i, j]`` to ``high[i, j]``: distances from split point i to split point j and all entries below it."""

    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    below: list[Node | None] = field(default_factory=list)


def build(entries: np.ndarray, numbers: np.ndarray | None = None) -> Node | None:
    """The tree over ``entries[numbers]``; split points are spread out: each is the entry farthest from those before it."""
    numbers = np.arange(len(entries)) if numbers is None else numbers
    if not len(numbers):
        return None
    between = squared(entries[numbers], entries[numbers])
    chosen, nearest = [0], between[0].copy()
    while len(chosen) < min(SPLITS, len(numbers)):
        chosen.append(int(np.argmax([-1 if i in chosen else x for i, x in enumerate(nearest)])))
        nearest = np.minimum(nearest, between[chosen[-1]])
    rest = np.setdiff1d(np.arange(len(numbers)), chosen)
    owner = np.array([int(np.argmin(between[i, chosen])) for i in rest], dtype="i8")
    far = roots(between[chosen])
    low, high = np.zeros((len(chosen), len(chosen))), np.zeros((len(chosen), len(chosen)))
    below = []
    for j, c in enumerate(chosen):
        members = np.concatenate([[c], rest[owner == j]]).astype("i8")
        low[:, j], high[:, j] = far[:, members].min(axis=1), far[:, members].max(axis=1)
        below.append(build(entries, numbers[rest[owner == j]]))
    return Node(numbers[chosen], low, high, below)


def nearest_entries(tree: Node, entries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(number, squared distance)`` of the nearest entry to each row, the lowest number of equal ones."""
    best = np.full(len(rows), len(entries), dtype="i8")
    least = squared(rows, entries[tree.points[:1]])[:, 0]

    def visit(node: Node, who: np.ndarray) -> None:
        squares = squared(rows[who], entries[node.points])
        for j, number in enumerate(node.points):
            better = (squares[:, j] < least[who]) | ((squares[:, j] == least[who]) & (number < best[who]))
            least[who[better]], best[who[better]] = squares[better, j], number
        away = roots(squares)
        for j, child in enumerate(node.below):
            if child is not None:
                with np.errstate(invalid="ignore"):
                    reach = roots(least[who])
                    slack = SLACK * (reach + away.max(axis=1) + node.high.max())
                    beyond = np.maximum(away - node.high[:, j], node.low[:, j] - away).max(axis=1) - reach
                if len(left := who[~(beyond > slack)]):
                    visit(child, left)

    visit(tree, np.arange(len(rows)))
    return best, least


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """``(rows, which have the length, their components as whole numbers)``."""
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            part = batch.slice(first, ROWS)
            vectors = part.column("vector")
            fits = np.diff(vectors.offsets.to_numpy()) == length
            flat = vectors.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype("f8")
            yield part, fits, whole_numbers(flat.reshape(int(fits.sum()), length))


@dataclass
class Codebooks:
    """Entries of each part position as whole numbers."""

    length: int
    entries: list[np.ndarray]

    @property
    def sha256(self) -> str:
        text = ",".join(str(int(x)) for part in self.entries for x in part.ravel())
        return hashlib.sha256(text.encode()).hexdigest()

    def trees(self) -> list[Node]:
        return [build(part) for part in self.entries]

    def assign(self, trees: list[Node], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(numbers, squared distances)``, one column a part."""
        cuts = cut_points(self.length, len(self.entries))
        found = [nearest_entries(t, e, rows[:, a:b]) for t, e, a, b in zip(trees, self.entries, cuts, cuts[1:])]
        return np.column_stack([n for n, _ in found]), np.column_stack([d for _, d in found])


def kept_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, label, vector`` of rows whose vector is there and has finite components only."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    return vectors.where(F.col(column).isNotNull() & finite).select("vec_id", label, F.col(column).cast("array<double>").alias("vector"))


def _sums(kept: DataFrame, books: Codebooks) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of one round: how many parts each entry is nearest to, and their sums, as Python integers."""
    sc = kept.sparkSession.sparkContext
    shared = sc.broadcast(books)  # fixed size: parts times entries times their components
    parts, size = len(books.entries), len(books.entries[0])
    cuts = cut_points(books.length, parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        trees = books.trees()
        counts = np.zeros((parts, size), dtype=object)
        sums = np.zeros((size, books.length), dtype=object)
        for _, _, rows in _blocks(batches, books.length):
            if not len(rows):
                continue
            numbers, _ = books.assign(trees, rows)
            for p in range(parts):
                counts[p] += np.bincount(numbers[:, p], minlength=size)
                for e in np.unique(numbers[:, p]):
                    sums[e, cuts[p] : cuts[p + 1]] += rows[numbers[:, p] == e, cuts[p] : cuts[p + 1]].sum(axis=0)
        line = [str(int(x)) for x in np.concatenate([counts.ravel(), sums.ravel()])]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % ADDERS], pa.int32()), pa.array([line], pa.list_(pa.string()))], ["adder", "line"])

    def merge(group: pa.Table) -> pa.Table:
        total = [0] * (parts * size + size * books_length)
        for line in group.column("line"):
            total = [a + int(b) for a, b in zip(total, line.as_py(), strict=True)]
        return pa.table({"line": pa.array([[str(x) for x in total]], pa.list_(pa.string()))})

    books_length = books.length
    lines = kept.select("vector").mapInArrow(add, "adder int, line array<string>").groupBy("adder").applyInArrow(merge, "line array<string>").collect()
    total = np.zeros(parts * size + size * books.length, dtype=object)
    for r in lines:  # ADDERS at most
        total += np.array([int(x) for x in r.line], dtype=object)
    counts, sums = total[: parts * size].reshape(parts, size), total[parts * size :].reshape(size, books.length)
    return list(counts), [sums[:, a:b] for a, b in zip(cuts, cuts[1:])]


def _numbers(values: np.ndarray) -> np.ndarray:
    """Whole numbers in 64 bits where a squared distance fits, else as they are."""
    return values.astype("i8") if not values.size or max(abs(int(x)) for x in values.ravel()) < 2**25 else values


def fit(kept: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> Codebooks | None:
    """Codebooks that start at the vectors with the smallest ids and are refined ``rounds`` times; None without a vector.

    All vectors of the first id's length take part. Of equal ids the smaller vector comes first, a null id last.
    """
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(1).collect()
    if not first:
        return None
    length = len(first[0].vector)
    start = kept.where(F.size("vector") == length).orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    rows, cuts = whole_numbers(np.array([r.vector for r in start], dtype="f8").reshape(len(start), length)), cut_points(length, parts)
    books = Codebooks(length, [rows[:, a:b] for a, b in zip(cuts, cuts[1:])])
    for _ in range(rounds):
        counts, sums = _sums(kept, books)
        books = Codebooks(length, [
            _numbers(np.array([[int(s) // int(n) for s in row] if n else list(old) for n, row, old in zip(c, total, part, strict=True)], dtype=object).reshape(part.shape))
            for c, total, part in zip(counts, sums, books.entries, strict=True)])
    return books


def encode(kept: DataFrame, books: Codebooks | None) -> DataFrame:
    """``vec_id, label, code, error`` of each row; both are null where the vector's length isn't the codebooks'."""
    shared = kept.sparkSession.sparkContext.broadcast(books)  # fixed size, as above
    fields = kept.select("vec_id", "label").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        if books is None:
            return
        trees = books.trees()
        for part, fits, rows in _blocks(batches, books.length):
            code, error = [None] * len(fits), [None] * len(fits)
            if len(rows):
                numbers, squares = books.assign(trees, rows)
                for i, n, e in zip(np.flatnonzero(fits).tolist(), numbers.tolist(), squares.astype(object).sum(axis=1).tolist(), strict=True):
                    code[i], error[i] = "".join(f"{x:02x}" for x in n), e if e < 1 << 63 else None
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return kept.mapInArrow(run, f"{kind}, code string, error long")


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector that is there and finite.

    ``label_error`` sums the errors of all rows with one label, null labels together. Repeated ids and rows each give a row;
    with fewer vectors than ``entries`` there are as many entries as vectors; a length that doesn't divide evenly is cut into
    parts whose lengths differ by one; rows of another length than the first id's have null code, error and no share in
    ``label_error``; an error beyond 64 bits is null; an empty table gives no rows; other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256: a code has two hex digits a part")
    kept = kept_vectors(vectors)
    books = fit(kept, parts, entries, rounds)
    coded = cut_lineage(encode(kept, books))
    total = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count(F.lit(1)).alias("rows"))
    total = total.select(F.struct("label").alias("group"), F.expr("try_cast(total AS BIGINT)").alias("label_error"), "rows")
    n = coded.count()
    found = hot_lookup(coded.withColumn("group", F.struct("label")), total, ["group"], F.col("rows") * 4096 >= n)  # 4096 labels at most
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.sha256 if books else None).cast("string").alias("codebooks_sha256"))


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The same in DuckDB's SQL, a step for each round."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT id, p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM
  (SELECT x.id, x.p, b.e, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN b{i} AS b ON b.p = x.p AND b.j = x.j GROUP BY x.id, x.p, b.e) GROUP BY id, p)""")
        if i < rounds:
            steps.append(f"""
u{i} AS (SELECT a.p, a.e, x.j, sum(x.v)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i} AS a JOIN x ON x.id = a.id AND x.p = a.p GROUP BY a.p, a.e, x.j),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, CASE WHEN n IS NULL THEN b.v ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS v
  FROM b{i} AS b LEFT JOIN u{i} AS u ON u.p = b.p AND u.e = b.e AND u.j = b.j)""")
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT id, (i - 1) * {parts} // len AS p, (i - 1) % (len // {parts}) AS j, floor(4096 * c::DOUBLE)::BIGINT AS v
  FROM (SELECT id, len(embedding) AS len, unnest(embedding) AS c, unnest(range(1, len(embedding) + 1)) AS i FROM k)),
b0 AS MATERIALIZED (SELECT p, id - 1 AS e, j, v FROM x WHERE id <= {entries}),{','.join(steps)},
h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b{rounds}),
r AS (SELECT id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN r USING (id), h"""
