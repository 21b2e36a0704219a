"""Near copies by word shingles: SimHash and banded MinHash find candidates, the shingle sets themselves decide.

Two texts are near copies when the Jaccard similarity of their sets of word shingles is at least 0.8. Texts with equal sets are
one class. Classes whose SimHash fingerprints lie within two bits are candidates first, found tile by tile
(``simhash.near_links``). Two bits are few at a similarity of 0.8, so MinHash finds the links beyond them: a class has ``BANDS``
keys of ``BAND_ROWS`` minimum hashes each; classes of similarity s share a key with probability
1 - (1 - s**BAND_ROWS)**BANDS, which is 0.999995 at 0.8. Every pair that shares a key is settled: it is compared exactly unless
both are joined already. Two rounds against one class of each key come first, so that a large group of near copies is joined in
links as many as its members. Classes that still share a key with one of another group are then put into clusters by shared
keys, and all pairs of a cluster are compared in blocks; a block hands on a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenseq.llm.common import row_key, texts_in_slices, whole
from lumenseq.llm.components import stars
from lumenseq.llm.simhash import SEED, forest, majority, near_links, shingle_hashes
from lumenseq.session import cut_lineage

WORDS_EACH = 5
#: Classes of one side of a block of a cluster.
SIDE = 256
BANDS, BAND_ROWS = 40, 6
_DRAW = np.random.default_rng(SEED)
_FACTOR = _DRAW.integers(0, 2**64, BANDS * BAND_ROWS, dtype="u8") | np.uint64(1)
_SHIFT = _DRAW.integers(0, 2**64, BANDS * BAND_ROWS, dtype="u8")


def shingle_set(text: str, words_each: int = WORDS_EACH) -> np.ndarray:
    """Sorted distinct hashes of the shingles; none for a text without words, one for fewer words than a shingle has."""
    return np.unique(shingle_hashes(text, words_each))


def band_keys(hashes: np.ndarray) -> list[int]:
    """The signed 64-bit keys of a set; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(len(_FACTOR), 2**64 - 1, dtype="u8")
    for first in range(0, len(hashes), 512):
        least = np.minimum(least, (hashes[first : first + 512, None] * _FACTOR + _SHIFT).min(axis=0))
    keys = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return np.array(keys, dtype="u8").view("i8").tolist()


def _class(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - 2**63


def _classes(rows: DataFrame) -> DataFrame:
    """``row, class, size, fp, bands`` of rows with ``row`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, prints, bands = [], [], [], []
            for _, texts in texts_in_slices(batch):
                for text in texts:
                    found = shingle_set(text)
                    names.append(_class(found))
                    sizes.append(len(found))
                    prints.append(majority(found))
                    bands.append(band_keys(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(prints, dtype="u8").view("i8")),
                 pa.array(bands, pa.list_(pa.int64()))], ["row", "class", "size", "fp", "bands"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.select("row", "text").mapInArrow(run, f"row {kind}, class long, size long, fp long, bands array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    """``class, shingles`` of rows with ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in texts_in_slices(batch):
                found = [shingle_set(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_class(x) for x in found], pa.int64()), pa.array([x.view("i8") for x in found], pa.list_(pa.int64()))], ["class", "shingles"])

    return rows.select("text").mapInArrow(run, "class long, shingles array<long>")


def _close(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sets have a similarity of 0.8 or more, in whole numbers."""
    left, right = (sets.select(F.col("class").alias(x), F.col("shingles").alias(f"_{x}")) for x in "ab")
    shared = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(left, "a").join(right, "b").where(9 * shared >= 4 * (F.size("_a") + F.size("_b"))).select("a", "b")


def close_in_block(sets: list[np.ndarray], names: np.ndarray, roots: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the close pairs of different roots, one marked ``left`` and one marked ``right``."""
    size = np.array([len(x) for x in sets])
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(size)])
    a, b = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
    marked = np.zeros(number.max() + 1, dtype="i8")
    for k in np.flatnonzero(left):
        mine = number[starts[k] : starts[k + 1]]
        marked[mine] = 1
        shared = np.add.reduceat(marked[number], starts[:-1])
        marked[mine] = 0
        found = names[right & (roots != roots[k]) & (9 * shared >= 4 * (size + size[k]))]
        a.append(np.full(len(found), names[k]))
        b.append(found)
    return forest(np.concatenate(a), np.concatenate(b))


def _close_in_clusters(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: links that connect all close pairs of the clusters that the buckets of ``rest`` (``band, class, root``) make."""
    first = rest.groupBy("band").agg(F.min("class").alias("b"))
    joined = stars(rest.join(first, "band").select(F.col("class").alias("a"), "b"))
    clusters = joined.union(joined.select(F.col("b").alias("a"), "b").distinct()).select(F.col("a").alias("class"), F.col("b").alias("cluster"))
    sides = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("sides"))
    placed = clusters.join(rest.select("class", "root").distinct(), "class").join(sides, "cluster").withColumn("side", F.pmod(F.xxhash64("class"), "sides").cast("int"))
    blocks = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).select(
        "cluster", F.least("side", "with").alias("low"), F.greatest("side", "with").alias("high"), "side", "class", "root")

    def compare(group: pa.Table) -> pa.Table:
        held = [np.asarray(x.values) for x in group.column("shingles")]
        side, names, roots = (group.column(c).to_numpy() for c in ("side", "class", "root"))
        a, b = close_in_block(held, names, roots, side == group.column("low")[0].as_py(), side == group.column("high")[0].as_py())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return blocks.join(sets, "class").groupBy("cluster", "low", "high").applyInArrow(compare, "a long, b long")


#: Sizes that a similarity of 0.8 allows for ``class`` and ``with``, and the two in order.
SIMILAR_SIZE = "5 * least(size, other) >= 4 * greatest(size, other)"
ORDERED = "least(class, with) AS a", "greatest(class, with) AS b"


def _by_fingerprint(classes: DataFrame) -> DataFrame:
    """``a, b``: one class of each fingerprint with the others of it, and with one of each fingerprint that a tile links to it."""
    prints = classes.where("size > 0").select("class", "size", "fp")
    first = cut_lineage(prints.groupBy("fp").agg(F.min(F.struct("class", "size")).alias("p")))
    same = prints.join(first, "fp").select("class", "size", F.col("p.class").alias("with"), F.col("p.size").alias("other"))
    left, right = (first.select(F.col("fp").alias(x), F.col("p").alias(f"p{x}")) for x in "ab")
    near = near_links(first.select("fp")).distinct().join(left, "a").join(right, "b").select(
        F.col("pa.class").alias("class"), F.col("pa.size").alias("size"), F.col("pb.class").alias("with"), F.col("pb.size").alias("other"))
    return cut_lineage(same.union(near).where("class <> with").where(SIMILAR_SIZE).selectExpr(*ORDERED).distinct())


def near_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``class, row`` with the least row of each class, and ``class, root`` of the classes joined to a smaller one."""
    rows = docs.select(row_key().alias("row"), whole().alias("text"))
    classes = cut_lineage(_classes(rows)).groupBy("class").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    classes = cut_lineage(classes)
    keyed = classes.select("class", "size", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    buckets = cut_lineage(keyed.join(shared, "band"))
    likely = _by_fingerprint(classes)
    named = buckets.select("class").union(likely.select("a")).union(likely.select("b")).distinct()
    wanted = named.join(classes.select("class", "row"), "class").select("row")
    sets = cut_lineage(_sets(rows.join(wanted, "row", "left_semi").dropDuplicates(["row"])))

    def open_buckets(roots: DataFrame) -> DataFrame:
        """Rows of the buckets whose classes are not all joined, with their roots."""
        named = buckets.join(roots, "class", "left").select("band", "class", "size", F.coalesce("root", "class").alias("root"))
        several = named.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
        return cut_lineage(named.join(several, "band"))

    links = cut_lineage(_close(likely, sets))
    roots = cut_lineage(stars(links).select(F.col("a").alias("class"), F.col("b").alias("root")))
    for turn in range(2):  # one class of each bucket against the others
        rest = open_buckets(roots)
        pivot = rest.groupBy("band").agg(F.min_by(F.struct("class", "size", "root"), F.xxhash64("class", F.lit(turn))).alias("p"))
        other = pivot.select("band", F.col("p.class").alias("with"), F.col("p.size").alias("other"), F.col("p.root").alias("other_root"))
        pairs = rest.join(other, "band").where("root <> other_root").where(SIMILAR_SIZE).selectExpr(*ORDERED).distinct()
        links = links.union(cut_lineage(_close(pairs, sets)))
        roots = cut_lineage(stars(links).select(F.col("a").alias("class"), F.col("b").alias("root")))
    links = links.union(cut_lineage(_close_in_clusters(open_buckets(roots), sets)))
    roots = cut_lineage(stars(links).select(F.col("a").alias("class"), F.col("b").alias("root")))
    return classes.select("class", "row"), roots


def representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of near copies: the least by id, nulls last, then by hash of the text.

    Rows that repeat both id and text count as one document. A null or empty text, or one of white space, has no shingle and
    is a near copy of the others without one; other columns are not read.
    """
    classes, roots = near_copies(docs)
    kept = classes.join(roots, "class", "left").groupBy(F.coalesce("root", "class").alias("root")).agg(F.min("row").alias("_row")).select("_row")
    return docs.select(F.struct("*").alias("doc"), row_key().alias("_row")).join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select("doc.*")
