"""Replay of many keys at once: a kernel steps all keys of a block together, run number by run number.

``walk`` streams its sorted rows through here in blocks. A block ends where a run ends, so it holds whole runs only, and the
last key's state goes on to the next block; memory is one block and one run. Built-in models have a kernel on NumPy arrays,
one array element a key (or key and KC). Where a block has too few keys for that to pay, and for user models, rows go
through the model's own steps one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lumenseq.operators.models import AbilityModel, BundleModel, DifficultyModel, ResidualModel

#: Rows of a block, about; keys that a step needs on average before a kernel pays.
BLOCK_ROWS, FEWEST_KEYS = 262_144, 6


def logistic(x: np.ndarray) -> np.ndarray:
    small = np.exp(-np.abs(x))
    return np.where(x >= 0, 1.0, small) / (1.0 + small)


def codes(column: pa.Array) -> np.ndarray:
    """Whole numbers that are equal where the values are, nulls included."""
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def starts_of(table: pa.Table, physical: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(seq, where a key or lane starts, where a run or a list of records starts)``."""
    key, lane, bundle = (codes(table.column(c).combine_chunks()) for c in ("_key", "_lane", "_bundle"))
    seq = table.column("_seq").to_numpy()
    first = np.ones(len(seq), bool)
    first[1:] = (key[1:] != key[:-1]) | (lane[1:] != lane[:-1])
    run = first.copy()
    run[1:] |= ((seq[1:] >= 0) & ((bundle[1:] != bundle[:-1]) | (seq[:-1] < 0)))
    if physical:
        run[1:] |= (seq[1:] >= 0) & (seq[1:] != seq[:-1] + 1)
    return seq, first, run


def blocks(batches: Iterator[pa.RecordBatch], physical: bool, size: int = BLOCK_ROWS) -> Iterator[pa.Table]:
    """Rows in blocks of about ``size`` that end where a run ends."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows >= size:
            table = pa.concat_tables(held).combine_chunks()
            cut = int(np.flatnonzero(starts_of(table, physical)[2])[-1])
            if cut:
                yield table.slice(0, cut).combine_chunks()
            held, rows = [table.slice(cut)], table.num_rows - cut
            size = max(size, 2 * rows)  # a run longer than a block: look again when twice as much is there
    if rows:
        yield pa.concat_tables(held).combine_chunks()


@dataclass
class Block:
    """The rows of a block, without state records: key number and run number in the key of each, columns by name."""

    key: np.ndarray
    run: np.ndarray
    columns: dict[str, pa.Array]
    states: list[Any]

    def numbers(self, name: str) -> np.ndarray:
        column = self.columns[name]
        if column.null_count:
            raise ValueError(f"column {name} must not be null in a replay")
        return column.to_numpy(zero_copy_only=False).astype("f8")

    @property
    def pays(self) -> bool:
        """Whether enough keys take part in a step on average."""
        steps = int(self.run.max(initial=-1)) + 1
        runs = np.count_nonzero(np.diff(self.key) | np.diff(self.run)) + 1
        return runs >= FEWEST_KEYS * steps


class Steps:
    """Rows in the order of the steps, and the bounds of steps and runs in it."""

    def __init__(self, block: Block):
        self.order = np.argsort(block.run, kind="stable")
        step, self.key = block.run[self.order], block.key[self.order]
        self.rows = np.concatenate([[0], np.cumsum(np.bincount(step))])
        change = np.ones(len(step), bool)
        change[1:] = (step[1:] != step[:-1]) | (self.key[1:] != self.key[:-1])
        self.first = np.flatnonzero(change)
        self.run = np.cumsum(change) - 1
        self.runs = np.searchsorted(self.first, self.rows)
        self.step = step

    def __iter__(self) -> Iterator[tuple[int, int, int, int]]:
        return zip(self.rows.tolist(), self.rows[1:].tolist(), self.runs.tolist(), self.runs[1:].tolist())

    def back(self, values: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        out[self.order] = values
        return out


@dataclass
class Result:
    """Model outputs by name in the order of the rows, state of each key, and records ``(key number, slot, values, clock)``."""

    outputs: dict[str, pa.Array]
    last_state: Any
    records: tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.float64()))


def ability(model: AbilityModel | ResidualModel, block: Block) -> Result:
    """One theta a key and, for residuals, one value a key and KC."""
    residual = isinstance(model, ResidualModel)
    steps, keys = Steps(block), len(block.states)
    take = steps.order
    b, correct = block.numbers("b")[take], block.numbers("correct")[take]
    weight = block.numbers(model.weight)[take] if model.weight is not None else np.ones(len(take))
    size = np.add.reduceat(weight, steps.first)
    run_key = steps.key[steps.first]
    theta = np.array([0.0 if s is None else (s[0] if residual else s) for s in block.states])
    seen_theta, p_global, r_bar = np.empty(len(take)), np.empty(len(take)), np.zeros(len(take))
    if residual:
        slots = Slots(model, block, steps, weight)
    for a, z, i, j in steps:
        key = steps.key[a:z]
        now = theta[key]
        p = logistic(now - b[a:z])
        seen_theta[a:z], p_global[a:z] = now, p
        error = correct[a:z] - weight[a:z] * p
        mean = np.add.reduceat(error, steps.first[i:j] - a) / size[i:j]
        if residual:
            r_bar[a:z] = slots.score(a, z)
            slots.commit(a, z, i, j, error, mean)
        who = run_key[i:j]
        theta[who] += model.theta_lr * (mean - model.l2 * theta[who])
    probability = logistic(seen_theta - b + r_bar) if residual else p_global
    outputs = {n: pa.array(steps.back(x)) for n, x in (("probability", probability), ("p_global", p_global), ("theta_pre", seen_theta), ("b_pre", b))}
    number, slot, values, clock = np.arange(keys), np.full(keys, -1), lists(theta, np.ones(keys, "i8")), pa.nulls(keys, pa.int64())
    last = theta[-1] if keys else None
    if residual:
        outputs |= {"r_bar": pa.array(steps.back(r_bar)), "r_pre": slots.r_pre()}
        number, slot = np.concatenate([number, slots.key]), np.concatenate([slot, slots.kc])
        pairs = np.column_stack([slots.value, slots.touches]).ravel()
        values = lists(np.concatenate([theta, pairs]), np.concatenate([np.ones(keys, "i8"), np.full(len(slots.value), 2)]))
        clock = pa.concat_arrays([clock, slots.clock_array()])
        last = (last, slots.of(keys - 1)) if keys else None
    return Result(outputs, last, (number, slot, values, clock))


class Slots:
    """Values of the (key, KC) pairs of a block, and which of them each step reads and changes."""

    def __init__(self, model: ResidualModel, block: Block, steps: Steps, weight: np.ndarray):
        self.model, self.steps = model, steps
        tags = block.columns[model.tags]
        if tags.null_count:
            raise ValueError(f"column {model.tags} must not be null in a replay")
        size = tags.value_lengths().to_numpy(zero_copy_only=False).astype("i8")
        if model.rule == "skill_mean" and (size != 1).any():
            raise ValueError("skill_mean needs exactly one KC per row")
        flat = tags.flatten().to_numpy(zero_copy_only=False).astype("i8")
        begin = np.cumsum(size) - size
        self.size = size[steps.order]
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        place = np.repeat(begin[steps.order] - self.begin[:-1], self.size) + np.arange(len(flat))
        self.place, kc = place, flat[place]
        self.row = np.repeat(np.arange(len(self.size)), self.size)
        held = [(k, c, *v) for k, state in enumerate(block.states) if state is not None for c, v in state[1].items()]
        pairs = np.concatenate([np.column_stack([steps.key[self.row], kc]), np.array([h[:2] for h in held], dtype="i8").reshape(-1, 2)])
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        change = np.ones(len(order), bool)
        change[1:] = (pairs[order][1:] != pairs[order][:-1]).any(axis=1)
        number = np.empty(len(order), "i8")
        number[order] = np.cumsum(change) - 1
        self.key, self.kc = pairs[order][change].T if len(order) else (np.zeros(0, "i8"), np.zeros(0, "i8"))
        self.slot, old = number[: len(flat)], number[len(flat) :]
        self.value, self.touches = np.zeros(len(self.key)), np.zeros(len(self.key))
        self.clock, self.timed = np.zeros(len(self.key), "i8"), np.zeros(len(self.key), bool)
        for s, (_, _, value, touches, clock) in zip(old.tolist(), held, strict=True):
            self.value[s], self.touches[s], self.clock[s], self.timed[s] = value, touches, clock or 0, clock is not None
        self.known = np.empty(len(flat))
        # a touch: one run changes one slot
        run = steps.run[self.row]
        order = np.lexsort((self.slot, run))
        change = np.ones(len(order), bool)
        change[1:] = (run[order][1:] != run[order][:-1]) | (self.slot[order][1:] != self.slot[order][:-1])
        self.touch = np.empty(len(order), "i8")
        self.touch[order] = np.cumsum(change) - 1
        self.touch_run, self.touch_slot = run[order][change], self.slot[order][change]
        self.touch_count = np.bincount(self.touch, weights=weight[self.row], minlength=len(self.touch_run))
        self.touches_of = np.searchsorted(self.touch_run, np.arange(len(steps.first) + 1))
        when = block.columns[model.clock]
        has = when.is_valid().to_numpy(zero_copy_only=False)[steps.order]
        ticks = pc.cast(when, pa.int64(), safe=False).fill_null(np.iinfo("i8").min).to_numpy(zero_copy_only=False)[steps.order]
        if model.rule == "token":
            self.run_clock, self.run_timed = np.maximum.reduceat(ticks, steps.first), np.logical_or.reduceat(has, steps.first)
        else:
            self.run_clock, self.run_timed = ticks[steps.first], has[steps.first]

    def score(self, a: int, z: int) -> np.ndarray:
        """Mean of each row's residuals, 0 without a KC."""
        f, g = self.begin[a], self.begin[z]
        self.known[f:g] = self.value[self.slot[f:g]]
        return np.bincount(self.row[f:g] - a, weights=self.known[f:g], minlength=z - a) / np.maximum(self.size[a:z], 1)

    def commit(self, a: int, z: int, i: int, j: int, error: np.ndarray, mean: np.ndarray) -> None:
        f, g, t, u = self.begin[a], self.begin[z], self.touches_of[i], self.touches_of[j]
        count, run, slot = self.touch_count[t:u], self.touch_run[t:u], self.touch_slot[t:u]
        if self.model.rule == "token":
            target = mean[run - i] / count
        else:
            target = np.bincount(self.touch[f:g] - t, weights=error[self.row[f:g] - a], minlength=u - t) / count
        self.value[slot] = (1.0 - self.model.eta) * self.value[slot] + self.model.eta * target
        self.touches[slot] += 1
        self.clock[slot], self.timed[slot] = self.run_clock[run], self.run_timed[run]

    def r_pre(self) -> pa.Array:
        values, size = np.empty(len(self.known)), self.steps.back(self.size)
        values[self.place] = self.known
        return lists(values, size)

    def clock_array(self) -> pa.Array:
        return pa.array(self.clock, pa.int64(), mask=~self.timed)

    def of(self, key: int) -> dict[int, tuple]:
        mine = np.flatnonzero(self.key == key)
        return {int(self.kc[s]): (float(self.value[s]), float(self.touches[s]), int(self.clock[s]) if self.timed[s] else None) for s in mine}


def difficulty(model: DifficultyModel, block: Block) -> Result:
    """One difficulty a key; the last row of a run decides its step."""
    steps = Steps(block)
    ends = np.append(steps.first[1:], len(steps.order)) - 1
    last, theta = block.numbers(model.last)[steps.order][ends], block.numbers("theta_pre")[steps.order][ends]
    run_key = steps.key[steps.first]
    b = np.array([0.0 if s is None else s for s in block.states])
    seen = np.empty(len(steps.order))
    for a, z, i, j in steps:
        seen[a:z] = b[steps.key[a:z]]
        who = run_key[i:j]
        now = b[who]
        b[who] = now + model.b_lr * (logistic(theta[i:j] - now) - last[i:j] - model.l2 * now)
    n = len(b)
    return Result({"b_new": pa.array(steps.back(seen))}, b[-1] if n else None, (np.arange(n), np.full(n, -1), lists(b, np.ones(n, "i8")), pa.nulls(n, pa.int64())))


KERNELS = {AbilityModel: ability, ResidualModel: ability, DifficultyModel: difficulty}


def one_by_one(model: BundleModel, block: Block, keys: list, wanted: list[str]) -> tuple[dict[str, list], list]:
    """The model's own steps: outputs in the order of the rows and the state of each key."""
    rows = zip(block.key.tolist(), block.run.tolist(), zip(*[block.columns[c].to_pylist() for c in wanted], strict=True))
    states = [model.load(k, []) if s is None else s for k, s in zip(keys, block.states, strict=True)]
    scored, at, gathered = [], None, None
    for key, run, values in rows:
        if at != (key, run):
            if at is not None:
                states[at[0]] = model.commit(states[at[0]], gathered)
            at, gathered = (key, run), None
        row = dict(zip(wanted, values))
        scored.append(model.score(states[key], row))
        gathered = model.gather(states[key], gathered, row)
    if at is not None:
        states[at[0]] = model.commit(states[at[0]], gathered)
    names = [n for n, _ in model.outputs]
    return dict(zip(names, map(list, zip(*scored)))) if scored else {n: [] for n in names}, states
