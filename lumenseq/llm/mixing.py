"""Mixing sources to target weights by Poisson replication.

A source's target rate is its share of the mixture over its share of the rows. Each document draws how often it appears
from a Poisson distribution with that mean, by inverting the distribution at a number hashed from seed and id, so the draw
is the same wherever and however often it runs. The copies are then dealt over all partitions by a hash of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenseq.llm.common import bucket_count, whole
from lumenseq.session import cut_lineage

#: Fixed value: hexadecimal digits of the md5 that make up a draw (52 bits, exact in a double).
_DIGITS = 13
#: Sources whose rates are broadcast at most; bytes of text in a partition of the result, about.
FEW_SOURCES, PARTITION_BYTES = 10_000, 64_000_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts, joined by a colon."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def poisson_table(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until twelve deviations beyond the mean, where nothing is left in a double."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    log_terms = F.transform(F.sequence(F.lit(0), last), lambda k: F.when(k > 0, F.ln(rate) - F.ln(k)).otherwise(-rate))
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("cdf"))

    def step(acc: Column, term: Column) -> Column:
        log = acc["log"] + term
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.array_append(acc["cdf"], total).alias("cdf"))

    return F.when(rate > 0, F.aggregate(log_terms, start, step)["cdf"]).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5) -> DataFrame:
    """``source, rate, cdf`` per source: how often a row of it should appear for the mixture to keep the size of ``docs``.

    ``weights`` gives shares of the mixture (of any sum); a source that it lacks has weight 0. Without it a source weighs
    its row count to the power of ``temperature``. A null source is a source like any other, and has weight 0 in ``weights``.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        weight = F.round(F.pow(F.col("_n").cast("double"), F.lit(temperature)) * 1e6).cast("long")
    else:
        most = max(weights.values(), default=0)
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        pairs = [x for k, w in weights.items() for x in (F.lit(k), F.lit(round(w / most * 10**9) if most else 0).cast("long"))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0)) if pairs else F.lit(0)
    weighted = counts.withColumn("_w", weight.cast("long"))  # whole numbers: their sum has one value, in any order
    sums = weighted.agg(F.sum("_n").cast("double").alias("_rows"), F.sum("_w").cast("double").alias("_all"))
    rates = weighted.crossJoin(F.broadcast(sums)).select(  # one row of sums
        "source", F.when(F.col("_all") > 0, F.col("_rows") * F.col("_w") / F.col("_all") / F.col("_n")).otherwise(0.0).alias("rate"))
    return rates.select("source", "rate", poisson_table(F.col("rate")).alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, seed: int = 17, key: Column | None = None) -> DataFrame:
    """The columns of ``docs`` with ``copy`` (from 1) and ``mix_key``; a row for each copy, dealt and sorted by ``mix_key``.

    The result may hold any row no, one or several times; its expected size is that of ``docs``. Rows with one ``key`` draw
    alike; without a ``key`` that is the id and the hash of the text, so rows without an id or with a shared one draw each by
    their text, and only rows that repeat both draw alike. A null text, an empty or very long one is carried as it is; an
    empty table gives no rows. Columns named ``copy`` or ``mix_key`` are replaced, all others kept.
    """
    docs = docs.drop("copy", "mix_key")
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(whole().cast("binary"))) if key is None else key
    rates = cut_lineage(source_rates(docs.select("source"), weights, temperature).select("source", "cdf"))
    if rates.count() <= FEW_SOURCES:
        rates = F.broadcast(rates)  # at most so many sources; beyond that the rows meet their rates by shuffle
    rows = docs.select(F.struct("*").alias("doc"), "source", key.alias("name")).withColumn("draw", uniform(F.lit(seed), F.col("name")))
    drawn = rows.alias("d").join(rates.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")))
    times = F.size(F.filter("r.cdf", lambda c: c <= F.col("d.draw"))).cast("long")
    copies = drawn.select("d.doc", "d.name", times.alias("times")).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    keyed = copies.withColumn("mix_key", uniform(F.lit(seed + 1), F.col("name"), F.col("copy")))
    # the number of partitions follows the bytes of text, so no task's share grows with the input
    return keyed.repartition(bucket_count(docs, PARTITION_BYTES), "mix_key").sortWithinPartitions("mix_key").select("doc.*", "copy", "mix_key")
