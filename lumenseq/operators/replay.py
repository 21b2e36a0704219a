"""Predict-before-update replay of bundles, one ordered stream per key.

``walk`` is the only physical operator: rows are shuffled by (key, lane), sorted
by ``seq`` and streamed through a model in blocks of whole runs; the built-in models
step all keys of a block together (``lockstep``). State records lead the stream of
their lane, so no key is ever held in memory whole. A hot key is cut into lanes at
run boundaries; ``lane_states`` finds the state every lane starts from,
after which all lanes replay in parallel and the result equals the serial pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from lumenseq.operators import lockstep
from lumenseq.operators import vocab as V
from lumenseq.operators.layout import HotKeys, hot_keys, is_hot
from lumenseq.operators.models import BundleModel
from lumenseq.operators.windows import runs
from lumenseq.session import cut_lineage

STATE_SCHEMA = "slot long, values array<double>, clock long, blob binary"
_STATE_FIELDS = ("slot", "values", "clock", "blob")


def empty_states(df: DataFrame, key: str) -> DataFrame:
    kind = df.schema[key].dataType
    return df.sparkSession.createDataFrame([], T.StructType([T.StructField(key, kind), *T.StructType.fromDDL(STATE_SCHEMA)]))


def walk(rows: DataFrame, model: BundleModel, states: DataFrame | None = None, key: str = "learner_id",
         bundle: str = "bundle_id", lane: str | None = None, physical: bool = False,
         keep: Sequence[str] = ()) -> DataFrame:
    """Stream every (key, lane) through ``model``; trace rows and final states come out together.

    Output: ``kind`` 0 rows carry the kept columns and the model outputs, ``kind`` 1
    rows carry the state records of a lane after its last bundle.
    """
    lane_col = F.col(lane) if lane else F.lit(0)
    kept = [c for c in dict.fromkeys([*keep]) if c not in (key, "seq")]
    wanted = list(dict.fromkeys([*model.columns, "correct"]))
    carried = list(dict.fromkeys([*kept, *wanted]))
    carried = [c for c in carried if c not in (key, "seq")]
    body = rows.select(
        F.col(key).alias("_key"), lane_col.cast("long").alias("_lane"), F.col("seq").cast("long").alias("_seq"),
        F.col(bundle).alias("_bundle"), *[F.col(c).alias(f"c_{c}") for c in carried],
        *[F.lit(None).cast(t).alias(f"s_{n}") for n, t in
          (("slot", "long"), ("values", "array<double>"), ("clock", "long"), ("blob", "binary"))],
    )
    if states is not None:
        lanes = F.col("_lane") if "_lane" in states.columns else F.lit(0)
        lead = states.select(
            F.col(key).alias("_key"), lanes.cast("long").alias("_lane"), F.lit(-1).cast("long").alias("_seq"),
            F.lit(None).cast(body.schema["_bundle"].dataType).alias("_bundle"),
            *[F.lit(None).cast(body.schema[f"c_{c}"].dataType).alias(f"c_{c}") for c in carried],
            *[F.col(n).alias(f"s_{n}") for n in _STATE_FIELDS],
        )
        body = body.unionByName(lead)
    # A fixed count keeps small-looking but Python-heavy partitions from being coalesced into one.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = body.repartition(parts, "_key", "_lane").sortWithinPartitions("_key", "_lane", "_seq", "s_slot")

    out = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField(key, rows.schema[key].dataType),
                        T.StructField("_lane", T.LongType()), T.StructField("seq", T.LongType())])
    for c in kept:
        out.add(T.StructField(c, rows.schema[c].dataType))
    for field in T.StructType.fromDDL(", ".join(f"{n} {k}" for n, k in model.outputs)):
        out.add(field)
    for field in T.StructType.fromDDL(STATE_SCHEMA):
        out.add(field)
    has_states = states is not None
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out.fields])

    def emit(kind: int, columns: dict, n: int) -> pa.RecordBatch:
        arrays = []
        for field in arrow:
            if field.name == "kind":
                arrays.append(pa.array([kind] * n, field.type))
            elif field.name in columns:
                got = columns[field.name]
                got = got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got
                arrays.append(got.cast(field.type) if isinstance(got, pa.Array) else pa.array(got, field.type))
            else:
                arrays.append(pa.nulls(n, field.type))
        return pa.RecordBatch.from_arrays(arrays, schema=arrow)

    kernel = lockstep.KERNELS.get(type(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_state = None, None

        def left_open() -> Iterator[pa.RecordBatch]:
            if open_key is not None and (found := model.save(open_state)):
                names = [key, "_lane", *_STATE_FIELDS]
                yield emit(1, {n: list(v) for n, v in zip(names, zip(*[(*open_key, *r) for r in found], strict=True), strict=True)}, len(found))

        for table in lockstep.blocks(batches, physical):
            seq, first, starts = lockstep.starts_of(table, physical)
            number = np.cumsum(first) - 1
            at = np.flatnonzero(first)
            keys = list(zip(table.column("_key").take(at).to_pylist(), table.column("_lane").take(at).to_pylist(), strict=True))
            states: list = [None] * len(keys)
            if has_states and (seq < 0).any():
                lead = table.filter(pa.array(seq < 0))
                records = zip(number[seq < 0].tolist(), zip(*[lead.column(f"s_{n}").to_pylist() for n in _STATE_FIELDS], strict=True), strict=True)
                for k, group in groupby(records, key=lambda x: x[0]):
                    states[k] = model.load(keys[k][0], [r for _, r in group])
            if keys[0] == open_key:
                states[0] = open_state
            else:
                yield from left_open()
            body = seq >= 0
            rows = table.filter(pa.array(body))
            run_number = np.cumsum(starts & body)[body]
            here = number[body]
            begin = np.ones(len(here), bool)
            begin[1:] = here[1:] != here[:-1]
            run_number -= np.repeat(run_number[begin], np.diff(np.append(np.flatnonzero(begin), len(here)))) if len(here) else 0
            block = lockstep.Block(here, run_number, {c: rows.column(f"c_{c}").combine_chunks() for c in wanted}, states)
            if kernel is not None and len(here) and block.pays:
                result = kernel(model, block)
                outputs, open_state = result.outputs, result.last_state
                who, slot, values, clock = result.records
                closed = who < len(keys) - 1
                if closed.any():
                    take = pa.array(np.flatnonzero(closed))
                    seats = pa.array(at[who[closed]])
                    yield emit(1, {key: table.column("_key").take(seats), "_lane": table.column("_lane").take(seats), "slot": pa.array(slot[closed]),
                                   "values": values.take(take), "clock": clock.take(take)}, len(take))
            else:
                outputs, final = lockstep.one_by_one(model, block, [k for k, _ in keys], wanted)
                open_state = final[-1]
                done = [(*k, *r) for k, state in zip(keys[:-1], final[:-1], strict=True) for r in model.save(state)]
                if done:
                    yield emit(1, {n: list(v) for n, v in zip([key, "_lane", *_STATE_FIELDS], zip(*done, strict=True), strict=True)}, len(done))
            open_key = keys[-1]
            if len(here):
                columns = {key: rows.column("_key"), "_lane": rows.column("_lane"), "seq": rows.column("_seq"), **{c: rows.column(f"c_{c}") for c in kept}, **outputs}
                yield emit(0, columns, len(here))
        yield from left_open()

    return stream.mapInArrow(run, out)


def trace_of(walked: DataFrame) -> DataFrame:
    return walked.where("kind = 0").drop("kind", "_lane", *_STATE_FIELDS)


def states_of(walked: DataFrame, key: str = "learner_id", last_lane: bool = True) -> DataFrame:
    """State records after the replay; with lanes, the latest record of every slot."""
    found = walked.where("kind = 1").select(key, "_lane", *_STATE_FIELDS)
    if not last_lane:
        return found
    picked = found.groupBy(key, "slot").agg(F.max_by(F.struct("values", "clock", "blob"), "_lane").alias("_s"))
    return picked.select(key, "slot", "_s.values", "_s.clock", "_s.blob")


def with_lanes(rows: DataFrame, key: str, bundle: str, physical: bool, hot: HotKeys) -> DataFrame:
    """Lane number of each row; hot keys are cut at run boundaries every ``width`` rows."""
    marked = runs(rows, bundle, physical, hot, [key])
    cut = F.floor(F.col("revealed") / F.lit(hot.width)).cast("long")
    return marked.select(*rows.columns, F.when(is_hot(hot), cut).otherwise(F.lit(0).cast("long")).alias("_lane"),
                         F.col("run_first_seq").alias("_run_key"))


def _fold_runs(laned: DataFrame, model: BundleModel, key: str, keep: Sequence[str], big: HotKeys) -> DataFrame:
    """Replace the rows of very large runs by one weighted row per distinct model input."""
    whole = laned.where(~is_hot(big)).withColumn("_w", F.lit(1).cast("long")).withColumn("_folded", F.lit(False))
    clock = getattr(model, "clock", None)
    inputs = [c for c in model.columns if c != clock]
    folded = laned.where(is_hot(big)).groupBy(key, "_lane", "_run_key", *inputs).agg(
        F.min("seq").alias("seq"), F.sum("correct").alias("correct"), F.count(F.lit(1)).alias("_w"),
        *([F.max(clock).alias(clock) if model.rule == "token" else F.min_by(clock, "seq").alias(clock)] if clock else []),
    ).withColumn("_folded", F.lit(True))
    return whole.unionByName(folded, allowMissingColumns=True)


def _unfold(walked: DataFrame, laned: DataFrame, model: BundleModel, key: str, keep: Sequence[str], big: HotKeys) -> DataFrame:
    """Give every row of a folded run the outputs of its weighted row."""
    inputs = [c for c in model.columns if c != getattr(model, "clock", None)]
    outputs = [n for n, _ in model.outputs]
    plain = walked.where("kind = 1 OR NOT _folded")
    scored = walked.where("kind = 0 AND _folded").select(key, "_run_key", "_lane", *inputs, *outputs)
    rows = laned.where(is_hot(big)).join(scored.withColumnRenamed("_lane", "_l"), [key, "_run_key", *inputs])
    shaped = rows.select(F.lit(0).alias("kind"), key, "_lane", "seq", *[c for c in keep if c not in (key, "seq")], *outputs)
    columns = [c for c in plain.columns if c not in ("_folded", "_run_key") and (c in keep or c not in inputs)]
    return plain.select(*columns).unionByName(shaped.select(*[c for c in columns if c in shaped.columns]), allowMissingColumns=True)


def _spread_start(lanes: DataFrame, states: DataFrame | None, key: str, hot: HotKeys) -> DataFrame | None:
    """Give every lane of a hot key the key's initial records as a first guess."""
    if states is None:
        return None
    return lanes.join(states, key)


def _shift(out: DataFrame, lanes: DataFrame, start: DataFrame | None, key: str) -> DataFrame:
    """State entering each lane: the records its predecessor lane left."""
    # One row per lane, and a lane stands for ``width`` rows, so this window is small.
    over = Window.partitionBy(key).orderBy("_lane")
    follows = lanes.select(key, "_lane", F.lead("_lane").over(over).alias("_to")).where(F.col("_to").isNotNull())
    moved = follows.join(out, [key, "_lane"]).select(key, F.col("_to").alias("_lane"), *_STATE_FIELDS)
    if start is None:
        return moved
    first = lanes.groupBy(key).agg(F.min("_lane").alias("_lane"))
    return moved.unionByName(first.join(start, key).select(key, "_lane", *_STATE_FIELDS))


def _gap(now: DataFrame, before: DataFrame, key: str) -> float:
    """Largest change of any state value between two rounds; any blob change counts as 1."""
    a = now.select(key, "_lane", "slot", F.col("values").alias("v1"), F.col("blob").alias("b1"), F.lit(1).alias("p1"))
    b = before.select(key, "_lane", "slot", F.col("values").alias("v2"), F.col("blob").alias("b2"), F.lit(1).alias("p2"))
    both = a.join(b, [key, "_lane", "slot"], "full")
    diff = F.aggregate(F.zip_with("v1", "v2", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda m, d: F.greatest(m, d))
    # A slot present on one side only starts from the model default, so compare its size with zero.
    lone = F.aggregate(F.coalesce("v1", "v2"), F.lit(0.0), lambda m, d: F.greatest(m, F.abs(d)))
    changed = F.when(~F.col("b1").eqNullSafe(F.col("b2")), 1.0).otherwise(0.0)
    step = F.greatest(F.when(F.col("p1").isNull() | F.col("p2").isNull(), F.coalesce(lone, F.lit(1.0))).otherwise(F.coalesce(diff, F.lit(0.0))), changed)
    return float(both.agg(F.coalesce(F.max(step), F.lit(0.0))).first()[0])


def lane_states(rows: DataFrame, model: BundleModel, states: DataFrame | None, key: str, bundle: str,
                physical: bool, hot: HotKeys, tolerance: float) -> DataFrame:
    """Starting state of every lane of the hot keys.

    Lanes start from a guess, replay in parallel and pass their final state to
    the next lane; the exchange repeats until nothing changes. After as many
    rounds as lanes it is exact for any model. Models that forget their starting
    point settle in two or three rounds. Slots with linear updates are composed
    in closed form once the main state is settled.
    """
    lanes = cut_lineage(rows.select(key, "_lane").distinct())
    head = model.head()
    start = states.join(lanes.select(key).distinct(), key, "left_semi") if states is not None else None
    main = start.where(F.col("slot") < 0) if (start is not None and head is not model) else start
    guess = _spread_start(lanes, main, key, hot)
    limit = int(lanes.groupBy(key).count().agg(F.max("count")).first()[0]) + 1
    for _ in range(limit):
        out = cut_lineage(states_of(walk(rows, head, guess, key, bundle, "_lane", physical), key, last_lane=False))
        nxt = cut_lineage(_shift(out, lanes, main, key))
        settled = guess is not None and _gap(nxt, guess, key) <= tolerance
        guess = nxt
        if settled:
            break
    if head is model:
        return guess
    # One pass from zero slots gives each lane's own contribution and touch count.
    lane_out = states_of(walk(rows, model, guess, key, bundle, "_lane", physical), key, last_lane=False)
    own = lane_out.where("slot >= 0").select(
        key, "_lane", "slot", F.col("values")[0].alias("c"), F.col("values")[1].alias("n"), "clock"
    )
    first = lanes.groupBy(key).agg(F.min("_lane").alias("_lane"))
    seeds = None
    if start is not None:
        seeds = first.join(start.where("slot >= 0"), key).select(
            key, "_lane", "slot", F.col("values")[0].alias("c"), F.lit(-1.0).alias("n"), "clock"
        )
        own = own.unionByName(seeds)
    decay = float(model.slot_decay)

    def compose(pdf):
        """Value of one slot before each of its lanes; a seed (n = -1) sorts first."""
        pdf = pdf.sort_values(["_lane", "n"])
        value, clock, found = 0.0, None, []
        for n, c, when in zip(pdf["n"], pdf["c"], pdf["clock"]):
            found.append((c, when) if n < 0 else (value, clock))
            value, clock = (c, when) if n < 0 else (c + value * decay ** n, when)
        res = pdf[[key, "slot", "_lane", "n"]].copy()
        res["value"] = [v for v, _ in found]
        res["clock"] = pd.array([None if pd.isna(w) else int(w) for _, w in found], dtype="Int64")
        return res.sort_values("n").drop_duplicates("_lane", keep="last").drop(columns="n")

    kind = rows.schema[key].dataType.simpleString()
    composed = own.groupBy(key, "slot").applyInPandas(
        compose, f"{key} {kind}, slot long, _lane long, value double, clock long")
    slots = composed.select(
        key, "_lane", "slot", F.array(F.col("value"), F.lit(0.0)).alias("values"), "clock",
        F.lit(None).cast("binary").alias("blob"),
    )
    return guess.select(key, "_lane", *_STATE_FIELDS).unionByName(slots)


def replay(rows: DataFrame, model: BundleModel, states: DataFrame | None = None, key: str = "learner_id",
           bundle: str = "bundle_id", physical: bool = False, keep: Sequence[str] = ("interaction_id", "correct"),
           hot: HotKeys | None = None, tolerance: float = 0.0) -> DataFrame:
    """Replay every key from its initial state; see ``trace_of`` and ``states_of``."""
    hot = hot_keys(rows, [key]) if hot is None else hot
    if not hot:
        return walk(rows, model, states, key, bundle, None, physical, keep)
    laned = cut_lineage(with_lanes(rows, key, bundle, physical, hot))
    big = hot_keys(laned.where(is_hot(hot)), [key, "_run_key"], hot.width)
    fold = bool(big) and model.weighted
    source, stepper = laned, model
    if fold:
        # One run may itself be huge: score its distinct inputs once, weighted.
        source, stepper = cut_lineage(_fold_runs(laned, model, key, keep, big)), model.with_weight("_w")
    entering = lane_states(source.where(is_hot(hot)), stepper, states, key, "_run_key", False, hot, tolerance)
    if states is not None:
        cold = states.where(~is_hot(hot)).withColumn("_lane", F.lit(0).cast("long"))
        entering = entering.unionByName(cold.select(*entering.columns))
    entering = cut_lineage(entering)
    if not fold:
        return walk(laned, model, entering, key, "_run_key", "_lane", False, keep)
    inputs = [c for c in model.columns if c != getattr(model, "clock", None)]
    walked = walk(source, stepper, entering, key, "_run_key", "_lane", False, [*keep, *inputs, "_folded", "_run_key"])
    return _unfold(cut_lineage(walked), laned, model, key, keep, big)


def bundle_pre_state(rows: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Responses revealed before each row's bundle, learner by learner in ``order``."""
    marked = runs(rows, "bundle_id", False, hot, ["learner_id"], ["order", "seq"])
    return marked.select("interaction_id", "learner_id", "bundle_id", "order", F.col("revealed").alias("pre_bundle_update_count"))


def count_baseline(rows: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Toy model ``1 / (1 + revealed)`` as a plain expression over the pre-state."""
    marked = runs(rows, "bundle_id", False, hot)
    return marked.withColumn("probability", 1.0 / (1.0 + F.col("revealed")))


def attach_difficulty(rows: DataFrame, difficulty: DataFrame, item: str = "item_id") -> DataFrame:
    """Item difficulty as a column; an unseen item has difficulty 0."""
    return rows.join(difficulty.select(F.col("item_id").alias(item), "b"), item, "left").withColumn(
        "b", F.coalesce("b", F.lit(0.0))
    )


def phase_input(rows: DataFrame, phase: str, learners: DataFrame, items: DataFrame, difficulty: DataFrame | None = None) -> DataFrame:
    """Rows of one split as a psychometric model takes them, with the difficulty ``b`` of each row where a table is given.

    Learners outside the vocabulary go. TRAIN and VALID also lose masked rows and rows of unknown items; TEST keeps an unknown
    item, unscored, under the first vocabulary item, whose difficulty therefore moves the learner's ability.
    """
    part = rows.where(F.col("split") == phase)
    coded = V.encode(V.encode(part, learners, "learner_id", "student_idx"), items, "item_id", "problem_idx")
    kept = V.kt1_phase_rows(coded, phase)
    if difficulty is None:
        return kept.select(*rows.columns)
    by_index = V.encode(difficulty, items, "item_id", "problem_idx").select("problem_idx", "b")
    return kept.join(by_index, "problem_idx", "left").select(*rows.columns, F.coalesce("b", F.lit(0.0)).alias("b"))


def run_trace(trace: DataFrame, with_runs: DataFrame, theta_lr: float, theta_l2: float, eta: float = 0.0,
              tags: str | None = None) -> DataFrame:
    """Add run-level columns: span, group error, KC token counts, post-update states."""
    joined = trace.join(with_runs.select("seq", "learner_id", "run", *([tags] if tags else [])), ["learner_id", "seq"])
    error = F.col("correct") - F.col("p_global")
    per_run = joined.groupBy("learner_id", "run").agg(
        F.min("seq").alias("run_start"), F.max("seq").alias("run_end"), F.avg(error).alias("e_group"),
        F.avg(error - theta_l2 * F.col("theta_pre")).alias("_step"),
    )
    out = joined.join(per_run, ["learner_id", "run"]).withColumn("theta_post", F.col("theta_pre") + theta_lr * F.col("_step"))
    if tags is None:
        return out.drop("_step")
    tokens = joined.select("learner_id", "run", F.explode(tags).alias("_kc")).groupBy("learner_id", "run", "_kc").agg(
        F.count(F.lit(1)).alias("_k"))
    counts = tokens.groupBy("learner_id", "run").agg(F.map_from_entries(F.collect_list(F.struct("_kc", "_k"))).alias("k_c"))
    with_counts = out.join(counts, ["learner_id", "run"], "left")
    post = F.zip_with(tags, "r_pre", lambda k, r: (1.0 - eta) * r + eta * (F.col("e_group") / F.col("k_c")[k]))
    return with_counts.withColumn("r_post", post).drop("_step")
