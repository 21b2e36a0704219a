"""Training replay with item difficulty shared by all learners.

The log is cut into time slices, each a stretch of whole runs in the global order. A slice is one ordered pass from the
abilities and difficulties that enter it. All slices run in parallel from a guess, and what they leave is handed on to the
later ones until nothing that enters a slice changes; the fixed point is the serial pass, reached at the latest after as many
sweeps as slices. A hot item or learner is spread over the slices like any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lumenseq.operators.layout import HotKeys, hot_keys
from lumenseq.operators.lockstep import codes
from lumenseq.operators.models import B_LR, L2, THETA_LR, AbilityModel, BundleModel, ResidualModel
from lumenseq.operators.replay import replay
from lumenseq.operators.windows import runs
from lumenseq.session import cut_lineage, hot_key_rows

STEP_TOLERANCE = 1e-13
#: Rows below which a slice is not cut further for more tasks; above the hot-key threshold it is cut in any case.
SLICE_ROWS = 131_072
_ROW, _LEARNER, _ITEM = 0, 1, 2


@dataclass
class Fit:
    """Converged training pass: per-row inputs, item table and learner states."""

    rows: DataFrame
    difficulty: DataFrame
    walked: DataFrame
    sweeps: int
    step: float


@dataclass
class Rates:
    theta_lr: float
    b_lr: float
    l2: float


class SerialPass:
    """Runs in their global order. A state is ``[value, slope, entered]``; the slope tells how far a change of what entered is still felt."""

    def __init__(self, rates: Rates):
        self.rates = rates
        self.states: dict[int, dict[Any, list[float]]] = {_LEARNER: {}, _ITEM: {}}
        self.run, self.mine, self.error, self.spread, self.rows = None, None, 0.0, 0.0, 0
        self.last: dict[Any, tuple] = {}

    def enter(self, side: int, key: Any, value: float) -> None:
        self.states[side][key] = [value, 1.0, value]

    def close(self) -> None:
        """Commit the open run: every item by its last response, the learner by the mean gradient."""
        if self.run is None:
            return
        r = self.rates
        for item, p, y in self.last.values():
            item[0] += r.b_lr * (p - y - r.l2 * item[0])
            item[1] *= 1.0 - r.b_lr * (p * (1.0 - p) + r.l2)
        mine = self.mine
        mine[0] += r.theta_lr * (self.error / self.rows - r.l2 * mine[0])
        mine[1] *= 1.0 - r.theta_lr * (self.spread / self.rows + r.l2)
        self.run = None

    def step(self, learners: list, run_keys: list, items: list, correct: list) -> list[float]:
        """Difficulty of each row before its run."""
        seen, exp = [], math.exp
        abilities, difficulties = self.states[_LEARNER], self.states[_ITEM]
        for learner, run, name, y in zip(learners, run_keys, items, correct, strict=True):
            if run != self.run:
                self.close()
                mine = abilities.get(learner)
                if mine is None:
                    mine = abilities[learner] = [0.0, 1.0, 0.0]
                self.run, self.mine, self.error, self.spread, self.rows, self.last = run, mine, 0.0, 0.0, 0, {}
            item = difficulties.get(name)
            if item is None:
                item = difficulties[name] = [0.0, 1.0, 0.0]
            x = self.mine[0] - item[0]
            if x >= 0:
                p = 1.0 / (1.0 + exp(-x))
            else:
                grown = exp(x)
                p = grown / (1.0 + grown)
            self.error += y - p
            self.spread += p * (1.0 - p)
            self.rows += 1
            self.last[name] = (item, p, y)
            seen.append(item[0])
        return seen


def _arrow(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])


def _sweep(rows: DataFrame, part: Column, slices: int, entering: DataFrame | None, rates: Rates,
           keep: Sequence[str] | None = None) -> DataFrame:
    """One pass over all slices: what each leaves by learner and item or, with ``keep``, these columns of every row and its ``b``."""
    needed = ["seq", "run_key", "learner_id", "item_id", "correct"]
    stream = rows.select(part.alias("_slice"), *dict.fromkeys([*needed, *(keep or ())]),
                         F.lit(_ROW).alias("_side"), F.lit(None).cast("double").alias("_value"))
    if entering is not None:
        before = F.lit(-1).cast("long")
        lead = entering.select("_slice", before.alias("seq"), before.alias("run_key"), "learner_id", "item_id", "_side", "_value")
        stream = stream.unionByName(lead, allowMissingColumns=True)
    stream = stream.repartitionById(slices, "_slice").sortWithinPartitions("_slice", "run_key", "seq")
    keys = [rows.schema["learner_id"], rows.schema["item_id"]]
    if keep is None:
        out = T.StructType([T.StructField("_side", T.IntegerType()), *keys, T.StructField("_slice", T.IntegerType()),
                            *[T.StructField(c, T.DoubleType()) for c in ("_from", "_to", "_slope")]])
    else:
        out = T.StructType([*[rows.schema[c] for c in keep], T.StructField("b", T.DoubleType())])
    arrow = _arrow(out)

    def left(serial: SerialPass, at: int) -> Iterator[pa.RecordBatch]:
        for side, column in ((_LEARNER, "learner_id"), (_ITEM, "item_id")):
            found = serial.states[side]
            if found:
                to, slope, entered = zip(*found.values(), strict=True)
                n = len(found)
                given = {"_side": [side] * n, column: list(found), "_slice": [at] * n, "_from": entered, "_to": to, "_slope": slope}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, at = SerialPass(rates), None
        for batch in batches:
            side = batch.column("_side").to_numpy()
            if len(side):
                at = batch.column("_slice")[0].as_py()
            lead = batch.filter(pa.array(side != _ROW))
            for kind, learner, item, value in zip(*[lead.column(c).to_pylist() for c in ("_side", "learner_id", "item_id", "_value")], strict=True):
                serial.enter(kind, learner if kind == _LEARNER else item, value)
            body = batch.filter(pa.array(side == _ROW))
            if body.column("correct").null_count:
                raise ValueError("column correct must not be null in a replay")
            seen = serial.step(*[body.column(c).to_pylist() for c in ("learner_id", "run_key", "item_id", "correct")])
            if keep is not None and seen:
                same = [body.column(c).cast(arrow.field(c).type) for c in keep]
                yield pa.RecordBatch.from_arrays([*same, pa.array(seen, pa.float64())], schema=arrow)
        serial.close()
        if keep is None and at is not None:
            yield from left(serial, at)

    return stream.mapInArrow(run, out)


def _handed_on(left: DataFrame) -> DataFrame:
    """What enters each slice: the value that the slice before left, corrected by its slope for the change of what entered there."""
    keys = ["_side", "learner_id", "item_id"]
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = left.repartition(parts, *keys).sortWithinPartitions(*keys, "_slice")
    out = T.StructType([*[left.schema[c] for c in keys], left.schema["_slice"], left.schema["_from"], T.StructField("_value", T.DoubleType())])
    arrow = _arrow(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nxt = None, 0.0
        for batch in batches:
            first = np.ones(batch.num_rows, bool)
            named = [codes(batch.column(c)) for c in keys]
            first[1:] = np.logical_or.reduce([n[1:] != n[:-1] for n in named])
            if batch.num_rows:
                ends = [tuple(batch.column(c)[i].as_py() for c in keys) for i in (0, batch.num_rows - 1)]
                first[0], key = ends[0] != key, ends[1]
            value = []
            for new, entered, to, slope in zip(first.tolist(), *[batch.column(c).to_pylist() for c in ("_from", "_to", "_slope")], strict=True):
                now = entered if new else nxt
                value.append(now)
                nxt = to + slope * (now - entered)
            found = pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*keys, "_slice", "_from")], pa.array(value, pa.float64())], schema=arrow)
            # a state that enters as zero, as before, needs no record
            yield found.filter(pa.array((np.array(value) != 0.0) | (found.column("_from").to_numpy() != 0.0)))

    return stream.mapInArrow(run, out)


def _first_guess(rows: DataFrame, part: Column, difficulty: DataFrame | None, states: DataFrame | None) -> DataFrame | None:
    """The initial states, for every slice that they occur in."""
    given = []
    if difficulty is not None:
        given.append((_ITEM, "item_id", "learner_id", difficulty.select("item_id", F.col("b").alias("_value"))))
    if states is not None:
        given.append((_LEARNER, "learner_id", "item_id", states.where("slot < 0").select("learner_id", F.col("values")[0].alias("_value"))))
    found = None
    for side, name, other, values in given:
        there = rows.select(part.alias("_slice"), name).distinct().join(values.where(F.col("_value").isNotNull()), name)
        mine = there.select(F.lit(side).alias("_side"), name, F.lit(None).cast(rows.schema[other].dataType).alias(other), "_slice", "_value")
        found = mine if found is None else found.unionByName(mine)
    return None if found is None else cut_lineage(found)


def train(rows: DataFrame, difficulty: DataFrame | None = None, states: DataFrame | None = None,
          residual: ResidualModel | None = None, bundle: str = "bundle_id", physical: bool = True,
          learn_b: bool = True, theta_lr: float = THETA_LR, b_lr: float = B_LR, l2: float = L2,
          tolerance: float = STEP_TOLERANCE, max_sweeps: int = 60, learner_hot: HotKeys | None = None) -> Fit:
    """TRAIN pass over rows with a dense global ``seq`` and integer or string item ids.

    Each sweep shuffles five narrow columns once. What enters a slice is handed on by learner and item; most of it is
    forgotten within a long slice, so few sweeps are needed however many rows there are.
    """
    learner_hot = hot_keys(rows, ["learner_id"]) if learner_hot is None else learner_hot
    extra = [residual.tags, residual.clock] if residual else []
    marked = runs(rows, bundle, physical, learner_hot).select(
        "seq", "learner_id", "item_id", F.col("run_first_seq").alias("run_key"), "correct",
        *[c for c in dict.fromkeys([*extra, "interaction_id", "metric_mask"]) if c in rows.columns],
    )
    marked = cut_lineage(marked)
    step, sweeps, table = float("inf"), 0, difficulty
    if learn_b:
        spark = rows.sparkSession
        count, low, high = marked.agg(F.count(F.lit(1)), F.min("run_key"), F.max("run_key")).first()
        most, parts = hot_key_rows(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
        slices = max(1, math.ceil(count / most), min(parts, math.ceil(count / min(SLICE_ROWS, most))))
        low, width = low or 0, max(1, math.ceil(((high or 0) - (low or 0) + 1) / slices))
        part = F.expr(f"CAST((run_key - {low}) DIV {width} AS INT)")
        rates, guess = Rates(theta_lr, b_lr, l2), _first_guess(marked, part, difficulty, states)
        while step > tolerance and sweeps < max_sweeps:
            left = cut_lineage(_sweep(marked, part, slices, guess, rates))
            guess = cut_lineage(_handed_on(left))
            step = float(guess.agg(F.max(F.abs(F.col("_value") - F.col("_from")))).first()[0] or 0.0)
            sweeps += 1
        if step > tolerance:
            raise RuntimeError(f"training has not settled after {sweeps} sweeps: last step {step:.3g}, wanted {tolerance:.3g}; raise max_sweeps")
        table = left.where(F.col("_side") == _ITEM).groupBy("item_id").agg(F.max_by("_to", "_slice").alias("b"))
        if difficulty is not None:
            table = table.unionByName(difficulty.join(table, "item_id", "left_anti").select("item_id", "b"))
        final_rows = _sweep(marked, part, slices, guess, rates, marked.columns)
    else:
        final_rows = marked.withColumn("b", F.lit(0.0)) if difficulty is None else marked.join(difficulty.select("item_id", "b"), "item_id", "left")
        final_rows = final_rows.withColumn("b", F.coalesce("b", F.lit(0.0)))
    model: BundleModel = residual if residual is not None else AbilityModel(theta_lr, l2)
    walked = replay(final_rows, model, states, "learner_id", "run_key", False,
                    keep=[c for c in ("interaction_id", "item_id", "correct", "metric_mask") if c in final_rows.columns], hot=learner_hot)
    return Fit(final_rows, table, walked, sweeps, step)
