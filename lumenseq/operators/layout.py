"""Order-aware building blocks that never put one hot key into one task.

``scan`` is the workhorse: a running aggregate along each key. Keys of ordinary
size run as a plain window. A key with more rows than the session threshold is
cut into slices of its order column, each slice runs as its own window group,
and the slice totals are carried forward. The result is the same either way.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lumenseq.session import HOT_KEY_LIMIT, cut_lineage, hot_key_rows

SLICE = "_slice"
UNSLICED = -(1 << 62)
PREFIX_BUCKET = 1 << 20


@dataclass(frozen=True)
class HotKeys:
    """The largest keys of one table and the slice width used for them.

    At most ``HOT_KEY_LIMIT`` keys are listed. The next largest key then holds
    less than one part in ``HOT_KEY_LIMIT`` of the rows, so it is not skewed.
    """

    key: tuple[str, ...]
    rows: tuple[tuple, ...]
    width: int
    schema: T.StructType

    def __bool__(self) -> bool:
        return len(self.rows) > 0


def hot_keys(df: DataFrame, key: Sequence[str], limit_rows: int | None = None) -> HotKeys:
    """Find keys above the threshold; the driver sees at most HOT_KEY_LIMIT ids."""
    width = limit_rows or hot_key_rows(df.sparkSession)
    key = tuple(key)
    top = (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > width)
        .orderBy(F.col("_n").desc(), *key)
        .limit(HOT_KEY_LIMIT)
    )
    found = tuple(tuple(r[c] for c in key) for r in top.collect())
    schema = T.StructType([df.schema[c] for c in key])
    return HotKeys(key, found, width, schema)


def hot_frame(df: DataFrame, hot: HotKeys) -> DataFrame:
    return df.sparkSession.createDataFrame(list(hot.rows), hot.schema)


def is_hot(hot: HotKeys) -> Column:
    """Predicate marking rows of hot keys (a literal hash set, at most HOT_KEY_LIMIT)."""
    if not hot:
        return F.lit(False)
    if len(hot.key) == 1:
        return F.coalesce(F.col(hot.key[0]).isin([r[0] for r in hot.rows]), F.lit(False))
    wanted = [
        F.struct(*[F.lit(v).cast(hot.schema[c].dataType).alias(c) for c, v in zip(hot.key, r)])
        for r in hot.rows
    ]
    return F.struct(*[F.col(c) for c in hot.key]).isin(wanted)


def order_columns(order: str | Sequence[str]) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def sliced(df: DataFrame, order: str | Sequence[str], hot: HotKeys) -> DataFrame:
    """Add the slice number: order // width for hot keys, one marker for the others."""
    number = F.floor(F.col(order_columns(order)[0]) / F.lit(hot.width)).cast("long")
    return df.withColumn(SLICE, F.when(is_hot(hot), number).otherwise(F.lit(UNSLICED)))


@dataclass(frozen=True)
class Running:
    """One running aggregate. ``how`` is sum, count, last, max or min."""

    name: str
    how: str
    value: Column | None = None
    inclusive: bool = False


def _windowed(spec: Running, over) -> Column:
    if spec.how == "count":
        return F.count(F.lit(1)).over(over)
    if spec.how == "sum":
        return F.coalesce(F.sum(spec.value).over(over), F.lit(0))
    if spec.how == "last":
        return F.last(spec.value, ignorenulls=True).over(over)
    return {"max": F.max, "min": F.min}[spec.how](spec.value).over(over)


def _total(spec: Running, order: list[str]) -> Column:
    if spec.how == "count":
        return F.count(F.lit(1))
    if spec.how == "sum":
        return F.sum(spec.value)
    if spec.how == "last":
        present = F.when(spec.value.isNotNull(), F.struct(*order))
        return F.max_by(spec.value, present)
    return {"max": F.max, "min": F.min}[spec.how](spec.value)


def _combine(spec: Running, local: Column, carried: Column) -> Column:
    if spec.how in ("count", "sum"):
        return local + F.coalesce(carried, F.lit(0))
    if spec.how == "last":
        return F.coalesce(local, carried)
    return {"max": F.greatest, "min": F.least}[spec.how](local, carried)


def scan(
    df: DataFrame,
    key: Sequence[str],
    order: str | Sequence[str],
    specs: Sequence[Running],
    hot: HotKeys | None = None,
) -> DataFrame:
    """Append running aggregates along ``order`` inside every ``key``.

    ``order`` is an integer column that is unique inside a key, or such a column
    followed by tie breakers.
    """
    key = list(key)
    order = order_columns(order)
    hot = hot_keys(df, key) if hot is None else hot
    if not hot:
        base = Window.partitionBy(*key).orderBy(*order)
        frames = {
            True: base.rowsBetween(Window.unboundedPreceding, 0),
            False: base.rowsBetween(Window.unboundedPreceding, -1),
        }
        return df.select("*", *[_windowed(s, frames[s.inclusive]).alias(s.name) for s in specs])

    cut = sliced(df, order, hot)
    base = Window.partitionBy(*key, SLICE).orderBy(*order)
    frames = {
        True: base.rowsBetween(Window.unboundedPreceding, 0),
        False: base.rowsBetween(Window.unboundedPreceding, -1),
    }
    local = cut.select("*", *[_windowed(s, frames[s.inclusive]).alias(s.name) for s in specs])
    totals = (
        cut.where(F.col(SLICE) != UNSLICED)
        .groupBy(*key, SLICE)
        .agg(*[_total(s, order).alias(f"_t_{s.name}") for s in specs])
    )
    before = Window.partitionBy(*key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *key,
        SLICE,
        *[
            _windowed(
                Running("c", "sum" if s.how == "count" else s.how, F.col(f"_t_{s.name}")), before
            ).alias(f"_c_{s.name}")
            for s in specs
        ],
    )
    joined = local.join(carry, [*key, SLICE], "left")
    kept = [F.col(c) for c in df.columns]
    return joined.select(
        *kept, *[_combine(s, F.col(s.name), F.col(f"_c_{s.name}")).alias(s.name) for s in specs]
    )


def key_totals(
    df: DataFrame,
    key: Sequence[str],
    order: str,
    totals: dict[str, tuple[str, Column]],
    hot: HotKeys | None = None,
) -> DataFrame:
    """Append per-key totals (``sum``, ``max`` or ``min``) to every row of the key."""
    key = list(key)
    hot = hot_keys(df, key) if hot is None else hot
    fn = {"sum": F.sum, "max": F.max, "min": F.min}
    if not hot:
        over = Window.partitionBy(*key)
        return df.select("*", *[fn[h](v).over(over).alias(n) for n, (h, v) in totals.items()])
    cut = sliced(df, order, hot)
    over = Window.partitionBy(*key, SLICE)
    local = cut.select("*", *[fn[h](v).over(over).alias(f"_l_{n}") for n, (h, v) in totals.items()])
    # One row per hot key, so at most HOT_KEY_LIMIT rows are broadcast.
    whole = df.where(is_hot(hot)).groupBy(*key).agg(*[fn[h](v).alias(n) for n, (h, v) in totals.items()])
    joined = local.join(F.broadcast(whole), key, "left")
    kept = [F.col(c) for c in df.columns]
    return joined.select(
        *kept,
        *[F.when(F.col(SLICE) != UNSLICED, F.col(n)).otherwise(F.col(f"_l_{n}")).alias(n) for n in totals],
    )


def prefix_by_int(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Exclusive running sum over a globally unique non-negative integer key.

    Two levels: windows over fixed-width key ranges (at most PREFIX_BUCKET rows
    each) and one window over the range totals.
    """
    bucketed = df.withColumn("_b", F.floor(F.col(key) / F.lit(PREFIX_BUCKET)).cast("long"))
    inner = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    local = bucketed.withColumn("_l", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    outer = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = bucketed.groupBy("_b").agg(F.sum(value).alias("_t"))
    offsets = totals.select("_b", F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_o"))
    kept = [F.col(c) for c in df.columns if c != name]
    return local.join(offsets, "_b").select(*kept, (F.col("_l") + F.col("_o")).alias(name))


def densify(df: DataFrame, order: str = "seq") -> DataFrame:
    """Renumber a globally unique integer order column 0..n-1 after a filter."""
    numbered = prefix_by_int(df, order, F.lit(1).cast("long"), "_dense")
    return numbered.withColumn(order, F.col("_dense")).drop("_dense")


def range_layout(df: DataFrame, keys: Sequence[Column | str], columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Range-partition and sort by a total order; return rows and partition sizes.

    The rows gain ``_at_part`` and ``_at_pos``. The layout is written to the
    shared folder once, so both results describe the same partitions; with
    ``columns`` only these are written.
    """
    laid = cut_lineage(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select(*(df.columns if columns is None else columns), F.monotonically_increasing_id().alias("_id"))
    )
    laid = laid.select(
        *[c for c in laid.columns if c != "_id"],
        F.shiftright("_id", 33).alias("_at_part"),
        F.col("_id").bitwiseAND((1 << 33) - 1).alias("_at_pos"),
    )
    return laid, laid.groupBy("_at_part").agg(F.count(F.lit(1)).alias("_rows"))


def ordinal(df: DataFrame, keys: Sequence[Column | str], name: str = "seq", columns: Sequence[str] | None = None) -> DataFrame:
    """Dense 0-based index in the total order of ``keys`` (which must be unique), beside ``columns`` or else all of them."""
    columns = list(df.columns if columns is None else columns)
    laid, sizes = range_layout(df, keys, columns)
    before = Window.orderBy("_at_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per physical partition, so this window and broadcast stay tiny.
    offsets = sizes.select("_at_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_off"))
    out = laid.join(F.broadcast(offsets), "_at_part")
    kept = [F.col(c) for c in columns if c != name]
    return out.select(*kept, (F.col("_off") + F.col("_at_pos")).alias(name))


def range_prefix(
    df: DataFrame, keys: Sequence[Column | str], sums: dict[str, Column]
) -> DataFrame:
    """Exclusive running sums over a global total order, split by range partition."""
    laid, _ = range_layout(df, keys)
    inner = Window.partitionBy("_at_part").orderBy("_at_pos").rowsBetween(Window.unboundedPreceding, -1)
    local = laid.select("*", *[F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"_l_{n}") for n, v in sums.items()])
    totals = laid.groupBy("_at_part").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    before = Window.orderBy("_at_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_at_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    joined = local.join(F.broadcast(offsets), "_at_part")
    return joined.select(
        *[F.col(c) for c in df.columns], *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums]
    )
