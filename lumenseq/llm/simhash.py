"""Near duplicates by SimHash, compared exactly in tiles.

Distinct fingerprints are dealt into tiles by the population counts of their four 16-bit quarters. Fingerprints within the
radius have counts that differ by no more than the radius in sum, so a tile is compared with the few tiles that near and all
other tile pairs are skipped. Inside a tile pair numpy takes exclusive-ors and counts bits. Large tiles are cut into blocks;
links of a block leave as a spanning forest, never as all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenseq.llm.common import row_key, texts_in_slices, whole
from lumenseq.llm.components import stars
from lumenseq.session import cut_lineage

SEED = 42
#: Fingerprints of a block's two sides.
OWNERS, VISITORS = 8_192, 65_536
#: Tasks that a class of exact copies is dealt over.
SALTS = 32
_SIDE = 17  # a quarter has 0 to 16 bits


def shingle_hashes(text: str, words_each: int) -> np.ndarray:
    """XXH64 of each shingle; a text of fewer words than a shingle is one shingle, a text without words has none."""
    words = text.encode().lower().split()  # bytes: A-Z alone is lowered, ASCII white space alone divides
    shifted = [words[i:] for i in range(words_each)] if len(words) > words_each else [[w] for w in words]
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*shifted, strict=False)), dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes; zero without any."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, dtype="i8")
    for first in range(0, len(hashes), 65_536):
        votes += np.unpackbits(hashes[first : first + 65_536].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words_each: int = 3) -> int:
    """Bits set in over half the shingles' XXH64; zero for a text without words."""
    return majority(shingle_hashes(text, words_each))


def fingerprints(docs: DataFrame, words_each: int = 3) -> DataFrame:
    """``doc_id, fp`` with the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, words_each) for _, texts in texts_in_slices(batch) for t in texts), dtype="u8", count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view("i8"))], ["doc_id", "fp"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole().alias("text")).mapInArrow(run, f"doc_id {id_type}, fp long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as ``a``-``b``, one for each node but the least of a component."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        if (label[a] == least).all() and (label[b] == least).all():
            break
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
    linked = label != np.arange(len(nodes))
    return nodes[linked], nodes[label[linked]]


def close_pairs(owners: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the two sides, tile by tile."""
    left, right = [np.zeros(0, "u8")], [np.zeros(0, "u8")]
    for i in range(0, len(owners), 512):
        for j in range(0, len(visitors), 8_192):
            near = np.bitwise_count(owners[i : i + 512, None] ^ visitors[None, j : j + 8_192]) <= radius
            x, y = np.nonzero(near)
            a, b = owners[i + x], visitors[j + y]
            a, b = a[a != b], b[a != b]
            if len(a):
                a, b = forest(a, b)
                left.append(a)
                right.append(b)
    return forest(np.concatenate(left), np.concatenate(right))


def _tile(quarters: list[Column]) -> Column:
    key = quarters[0]
    for q in quarters[1:]:
        key = key * _SIDE + q
    return key.cast("int")


def near_links(distinct: DataFrame, radius: int = 2, owners: int = OWNERS, visitors: int = VISITORS) -> DataFrame:
    """``a, b``: links that connect exactly the fingerprints of ``distinct`` (column ``fp``) within ``radius`` bits."""
    quarter = [F.expr(f"bit_count(shiftrightunsigned(fp, {s}) & 65535L)") for s in (48, 32, 16, 0)]
    rows = distinct.select("fp", *[q.alias(f"q{i}") for i, q in enumerate(quarter)])
    steps = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]
    near = F.explode(F.filter(F.array(*[
        F.when(F.lit(True) & F.expr(" AND ".join(f"q{i} + ({x}) BETWEEN 0 AND {_SIDE - 1}" for i, x in enumerate(d))),
               _tile([F.col(f"q{i}") + x for i, x in enumerate(d)])) for d in steps
    ]), lambda t: t.isNotNull()))
    # at most 17**4 tiles: small enough to broadcast, however many fingerprints there are
    sizes = rows.groupBy(*[f"q{i}" for i in range(4)]).agg(F.count(F.lit(1)).alias("n"))
    grid = (
        sizes.select("n", _tile([F.col(f"q{i}") for i in range(4)]).alias("home"), near.alias("tile"))
        .groupBy("tile").agg(F.sum("n").alias("guests"), F.sum(F.when(F.col("home") == F.col("tile"), F.col("n")).otherwise(0)).alias("own"))
        .where("own > 0")
        .select("tile", F.ceil(F.col("own") / owners).cast("int").alias("rows"), F.ceil(F.col("guests") / visitors).cast("int").alias("cols"))
    )
    grid = F.broadcast(cut_lineage(grid))
    mix = F.xxhash64("fp", F.lit(1))
    mine = rows.select("fp", _tile([F.col(f"q{i}") for i in range(4)]).alias("tile")).join(grid, "tile").select(
        "tile", F.pmod(mix, F.col("rows")).cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"), "fp", F.lit(True).alias("owner"))
    theirs = rows.select("fp", near.alias("tile")).join(grid, "tile").select(
        "tile", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.pmod(mix, F.col("cols")).cast("int").alias("col"), "fp", F.lit(False).alias("owner"))

    def compare(group: pa.Table) -> pa.Table:
        fp, owner = group.column("fp").to_numpy().view("u8"), group.column("owner").to_numpy()
        a, b = close_pairs(fp[owner], fp[~owner], radius)
        return pa.table({"a": pa.array(a.view("i8")), "b": pa.array(b.view("i8"))})

    return mine.union(theirs).groupBy("tile", "row", "col").applyInArrow(compare, "a long, b long")


def simhash_components(docs: DataFrame, radius: int = 2, words_each: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    A null or empty text, or one of white space, has fingerprint zero and links like any other; a text of fewer words than a
    shingle is one shingle; repeated rows share a component; a null id is never the smallest of a component unless all are
    null; an empty table gives no rows; other columns are not read.
    """
    prints = cut_lineage(fingerprints(docs, words_each))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    joined = stars(near_links(prints.select("fp").distinct(), radius))
    roots = joined.union(joined.select(F.col("b").alias("a"), "b").distinct())  # every linked fingerprint with its root
    linked = classes.join(roots.withColumnRenamed("a", "fp"), "fp")
    smallest = linked.groupBy("b").agg(F.min("least").alias("component_id"))
    linked = linked.join(smallest, "b").select("fp", "component_id")
    names = classes.join(linked, "fp", "left").select("fp", "n", "least", F.coalesce("component_id", "least").alias("component_id"))
    alone = names.where("n = 1").select(F.col("least").alias("doc_id"), "fp", "component_id")
    # exact copies may be a third of all rows: each class of copies is dealt over several tasks
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    copies = names.where("n > 1").select("fp", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copied = prints.withColumn("salt", salt).join(copies, ["fp", "salt"]).select("doc_id", "fp", "component_id")
    return alone.union(copied).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, radius: int = 2, words_each: int = 3) -> DataFrame:
    """One row of ``docs`` for each component: the least by id, nulls last, then by hash of the text.

    Rows that repeat both id and text count as one document.
    """
    named = simhash_components(docs.select(row_key().alias("doc_id"), "text"), radius, words_each)
    least = named.where("doc_id = component_id").select(F.col("doc_id").alias("_row")).distinct()
    return docs.select(F.struct("*").alias("doc"), row_key().alias("_row")).join(least, "_row", "left_semi").dropDuplicates(["_row"]).select("doc.*")
