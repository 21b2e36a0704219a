"""Cohort prefixes, seeded samples and bundle-safe caps."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenseq.operators.layout import ordinal, prefix_by_int


def first_ids(df: DataFrame, column: str, n: int) -> DataFrame:
    """First ``n`` distinct ids in code-point order (a top-n plan, no full sort)."""
    if n < 1:
        raise ValueError(f"n must be >= 1, got {n}")
    top = df.select(column).distinct().orderBy(column).limit(n)
    have = top.count()
    if have < n:
        raise ValueError(f"requested {n} ids but only {have} are available")
    return top


def hash_sample(df: DataFrame, column: str, k: int, seed: str) -> DataFrame:
    """``k`` distinct ids with the smallest seeded SHA-256, the same on any engine."""
    token = F.sha2(F.concat(F.lit(seed), F.lit(":"), F.col(column).cast("string")), 256)
    return df.select(column).distinct().withColumn("_h", token).orderBy("_h", column).limit(k).drop("_h")


def _below(rng: random.Random, n: int) -> int:
    width = n.bit_length()
    while True:
        drawn = rng.getrandbits(width)
        if drawn < n:
            return drawn


def sample_positions(n: int, k: int, seed: int) -> list[int]:
    """Sorted positions drawn without replacement; they depend on n, k and seed only.

    Small populations use a virtual swap table, large ones reject repeats. Both
    keep memory at O(k), whatever the population size.
    """
    if not 0 <= k <= n:
        raise ValueError(f"sample size {k} is outside 0..{n}")
    rng = random.Random(seed)
    threshold = 21 + (4 ** math.ceil(math.log(3 * k, 4)) if k > 5 else 0)
    drawn: list[int] = []
    if n <= threshold:
        moved: dict[int, int] = {}
        for last in range(n - 1, n - 1 - k, -1):
            at = _below(rng, last + 1)
            drawn.append(moved.get(at, at))
            moved[at] = moved.get(last, last)
    else:
        taken: set[int] = set()
        while len(drawn) < k:
            at = _below(rng, n)
            if at not in taken:
                taken.add(at)
                drawn.append(at)
    return sorted(drawn)


def seeded_sample(population: DataFrame, column: str, k: int, seed: int) -> DataFrame:
    """Seeded sample of the sorted distinct ids, returned with their ordinals.

    Only ``k`` integers leave the driver; they are broadcast because their
    number is the argument itself.
    """
    numbered = ordinal(population.select(column).where(F.col(column) != "").distinct(), [column], "idx")
    n = numbered.count()
    spark = population.sparkSession
    picks = spark.createDataFrame([(i,) for i in sample_positions(n, k, seed)], "idx long")
    return numbered.join(F.broadcast(picks), "idx", "left_semi")


def cohort_rows(df: DataFrame, cohort: DataFrame, column: str = "learner_id") -> DataFrame:
    return df.join(cohort.select(column), column, "left_semi")


def epoch_shuffle(df: DataFrame, column: str, seed: str, epoch: int) -> DataFrame:
    """Rank of every id in a seeded per-epoch order."""
    token = F.sha2(F.concat_ws(":", F.lit(seed), F.lit(str(epoch)), F.col(column).cast("string")), 256)
    return ordinal(df.select(column).distinct().withColumn("_h", token), ["_h", column], "position").drop("_h")


def first_rows(df: DataFrame, n: int, most: int = 64) -> DataFrame:
    """First ``n`` rows in stored order, a smoke-run feature."""
    if not 1 <= n <= most:
        raise ValueError(f"n must be in 1..{most}, got {n}")
    return df.orderBy("seq").limit(n)


def cap_whole_bundles(with_runs: DataFrame, max_rows: int) -> DataFrame:
    """Whole bundles until the next would pass ``max_rows``; the first one always stays.

    ``with_runs`` needs learner-contiguous dense ``seq`` and ``run_first_seq``
    (the seq of the run's first row), so a run covers rows before it exactly.
    """
    sizes = with_runs.groupBy("learner_id", "run_first_seq").agg(F.count(F.lit(1)).alias("_n"))
    kept = sizes.where((F.col("run_first_seq") == 0) | (F.col("run_first_seq") + F.col("_n") <= max_rows))
    return with_runs.join(kept.select("run_first_seq"), "run_first_seq", "left_semi")
