"""Batch preparation for sequence models and the parity-window search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenseq.operators.layout import HotKeys, Running, ordinal, scan
from lumenseq.operators.models import BundleModel
from lumenseq.operators.replay import replay, trace_of
from lumenseq.session import cut_lineage


class ChunkModel(BundleModel):
    """Greedy packing of whole runs: a chunk closes when the next run would pass the target.

    Reads one row per run with its length, so it is the streaming walker with a
    two-number state and splits over lanes like any other model.
    """

    columns = ("run_rows",)
    outputs = (("chunk", "long"),)

    def __init__(self, target_rows: int):
        self.target = target_rows

    def load(self, key, records):
        return tuple(int(v) for v in records[0][1]) if records else (0, 0)

    def save(self, state):
        return [(-1, [float(v) for v in state], None, None)]

    def _next(self, state, n):
        chunk, filled = state
        return (chunk + 1, n) if filled and filled + n > self.target else (chunk, filled + n)

    def score(self, state, row):
        return (self._next(state, row["run_rows"])[0],)

    def gather(self, state, gathered, row):
        return self._next(state, row["run_rows"])

    def commit(self, state, gathered):
        return gathered


def tbptt_chunks(spans: DataFrame, target_rows: int, hot: HotKeys | None = None) -> DataFrame:
    """Chunk number of every run; a run is never split and an oversize run stands alone."""
    runs = spans.select("learner_id", F.col("run").alias("seq"), F.col("run").alias("run_key"), "run_rows",
                        F.lit(0).cast("long").alias("correct"))
    packed = trace_of(replay(runs, ChunkModel(target_rows), bundle="run_key", keep=("run_rows",), hot=hot))
    return packed.select("learner_id", F.col("seq").alias("run"), "run_rows", "chunk")


def learner_slabs(chunks: DataFrame, width: int) -> DataFrame:
    """Batch id of every chunk: learners in groups of ``width``, one chunk of each per step."""
    learners = ordinal(chunks.select("learner_id").distinct(), ["learner_id"], "learner_rank")
    pool = F.floor(F.col("learner_rank") / F.lit(width)).cast("long")
    return chunks.join(learners, "learner_id").withColumn("pool", pool).withColumn("step", F.col("chunk"))


def _latest_before(df: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """Per run: the latest earlier place (``run_first_seq``) at which one of the run's keys stood before."""
    seen = scan(df, key, order, [Running("_before", "max", F.col("run_first_seq"))])
    return seen.groupBy("run_first_seq").agg(F.max("_before").alias(name))


def parity_window(rows: DataFrame, max_len: int | None = None) -> DataFrame:
    """Earliest span of complete runs in which all ten coverage conditions hold.

    ``rows`` has a dense global ``seq``, ``run_first_seq`` of the physical run,
    ``learner_id``, ``bundle_id``, ``item_id``, ``correct``, ``tags`` and
    ``sentinel``. Runs with a sentinel are barriers; the span starts right after
    the previous barrier and ends with the first run that completes the set.

    A repetition lies inside the span when the key's latest earlier place is past
    the last barrier, so each condition is a mark on its run and one grouping
    by the last barrier merges all ten. Empty input gives no row.
    """
    rows = cut_lineage(rows.select("seq", "run_first_seq", "learner_id", "bundle_id", "item_id", "correct", "tags", "sentinel"))
    per_run = rows.groupBy("run_first_seq").agg(
        F.first("learner_id").alias("learner_id"), F.first("bundle_id").alias("bundle_id"),
        F.count(F.lit(1)).alias("n"), F.max(F.col("sentinel").cast("int")).alias("barrier"),
        F.max((F.col("correct") == 0).cast("int")).alias("has0"), F.max((F.col("correct") == 1).cast("int")).alias("has1"),
        F.max((F.size("tags") >= 2).cast("int")).alias("multi"),
        F.max((F.size("tags") != F.size(F.array_distinct("tags"))).cast("int")).alias("repeat"),
    )
    concepts = rows.select("run_first_seq", F.explode("tags").alias("kc")).distinct()
    pairs = scan(per_run.select("run_first_seq", "learner_id", "bundle_id"), ["learner_id", "bundle_id"], "run_first_seq",
                 [Running("pair_before", "max", F.col("run_first_seq"))]).select("run_first_seq", "pair_before")
    marked = per_run.join(pairs, "run_first_seq").join(
        _latest_before(rows.select("run_first_seq", "seq", "item_id"), ["item_id"], ["seq"], "item_before"), "run_first_seq").join(
        _latest_before(concepts, ["kc"], ["run_first_seq"], "kc_before"), "run_first_seq", "left")
    placed = scan(marked.withColumn("_all", F.lit(0)), ["_all"], "run_first_seq", [
        Running("since", "max", F.when(F.col("barrier") == 1, F.col("run_first_seq"))),
        Running("learner_before", "last", F.col("learner_id")), Running("run_before", "max", F.col("run_first_seq"))])
    since = F.coalesce("since", F.lit(-1))
    met = {
        "single": F.col("n") == 1, "several": F.col("n") > 1, "zero": F.col("has0") == 1, "one": F.col("has1") == 1,
        "multi": F.col("multi") == 1, "repeat": F.col("repeat") == 1, "reappear": F.col("pair_before") > since,
        "item": F.col("item_before") > since, "exposure": F.col("kc_before") > since,
        "learners": (F.col("run_before") > since) & (F.col("learner_before") != F.col("learner_id")),
    }
    place = F.struct("run_first_seq", "n")
    spans = placed.where("barrier = 0").groupBy(since.alias("since")).agg(
        F.min("run_first_seq").alias("start"), *[F.min(F.when(held, place)).alias(name) for name, held in met.items()])
    for name in met:
        spans = spans.where(F.col(name).isNotNull())
    last = F.greatest(*met)
    spans = spans.select("start", (last["run_first_seq"] + last["n"]).alias("end"))
    if max_len is not None:
        spans = spans.where(F.col("end") - F.col("start") <= max_len)
    return spans.orderBy("start").limit(1).select("start", "end")
