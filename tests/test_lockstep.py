"""Kernels that step many keys together against the models' own steps, and blocks that end where runs end."""

import numpy as np
import pyarrow as pa
import pytest

from lumenseq.operators import lockstep
from lumenseq.operators.models import AbilityModel, DifficultyModel, ResidualModel


def block(seed, keys, one_tag=False, states=()):
    rng = np.random.default_rng(seed)
    key, run, columns = [], [], {"b": [], "correct": [], "tag_idxs": [], "timestamp": [], "theta_pre": [], "_w": []}
    for k in range(keys):
        for r in range(rng.integers(1, 9)):
            for _ in range(rng.integers(1, 5)):
                key.append(k)
                run.append(r)
                columns["b"].append(float(rng.normal()))
                columns["correct"].append(int(rng.integers(0, 2)))
                columns["tag_idxs"].append(rng.integers(0, 6, 1 if one_tag else rng.integers(0, 4)).tolist())
                columns["timestamp"].append(int(rng.integers(0, 1000)) if rng.random() < 0.8 else None)
                columns["theta_pre"].append(float(rng.normal()))
                columns["_w"].append(int(rng.integers(1, 4)))
    kinds = {"correct": pa.int32(), "tag_idxs": pa.list_(pa.int64()), "timestamp": pa.int64(), "_w": pa.int64()}
    return lockstep.Block(np.array(key), np.array(run), {c: pa.array(v, kinds.get(c, pa.float64())) for c, v in columns.items()}, [*states, *[None] * (keys - len(states))])


MODELS = [
    (AbilityModel(), False, [0.4, None, -1.0]), (AbilityModel(weight="_w"), False, []), (DifficultyModel(), False, [0.3]),
    (ResidualModel(), False, [(0.2, {3: (0.5, 0.0, 7), 99: (-0.25, 0.0, None)})]), (ResidualModel(rule="skill_mean"), True, []),
    (ResidualModel(weight="_w"), False, [None, (0.1, {})]),
]


@pytest.mark.parametrize("model, one_tag, states", MODELS)
@pytest.mark.parametrize("keys", [1, 40])
def test_kernel_equals_single_steps(model, one_tag, states, keys):
    made = block(keys, keys, one_tag, states[:keys])
    result = lockstep.KERNELS[type(model)](model, made)
    wanted = list(dict.fromkeys([*model.columns, "correct"]))
    copied = lockstep.Block(made.key, made.run, made.columns, [(s[0], dict(s[1])) if isinstance(s, tuple) else s for s in made.states])
    outputs, final = lockstep.one_by_one(model, copied, list(range(keys)), wanted)
    for name, values in outputs.items():
        got = result.outputs[name].to_pylist()
        assert len(got) == len(values)
        flat = lambda x: np.concatenate([np.atleast_1d(np.array(v, dtype="f8")) for v in x])
        assert list(map(np.size, got)) == list(map(np.size, values)) and np.abs(flat(got) - flat(values)).max() < 1e-12
    who, slot, values, clock = result.records
    got = {(int(k), int(s)): (v, c) for k, s, v, c in zip(who, slot, values.to_pylist(), clock.to_pylist())}
    want = {(k, s): (v, c) for k, state in enumerate(final) for s, v, c, _ in model.save(state)}
    assert got.keys() == want.keys()
    assert all(got[x][0] == pytest.approx(want[x][0], abs=1e-12) and got[x][1] == want[x][1] for x in want)
    assert {s: v for s, v, *_ in model.save(result.last_state)} == {s: v for (k, s), (v, _) in got.items() if k == keys - 1}


@pytest.mark.parametrize("size", [1, 7, 50, 10_000])
@pytest.mark.parametrize("physical", [False, True])
def test_blocks_end_where_runs_end(size, physical):
    rng = np.random.default_rng(2)
    rows = []
    for k in ("a", "b", None, "d"):
        for s in range(rng.integers(0, 3)):
            rows.append((k, 0, -1, None, s))
        bundle, seq = 0, 0
        for _ in range(60):
            bundle += int(rng.random() < 0.3)
            seq += 1 + int(rng.random() < 0.2)
            rows.append((k, 0, seq, f"u{bundle}" if bundle % 4 else None, None))
    table = pa.table({"_key": [r[0] for r in rows], "_lane": pa.array([r[1] for r in rows], pa.int64()), "_seq": pa.array([r[2] for r in rows], pa.int64()), "_bundle": pa.array([r[3] for r in rows], pa.string())})
    found = list(lockstep.blocks(iter(table.to_batches(max_chunksize=9)), physical, size))
    assert pa.concat_tables(found).to_pylist() == table.to_pylist()
    _, _, starts = lockstep.starts_of(table, physical)
    places = set(np.flatnonzero(starts).tolist())
    ends = np.cumsum([t.num_rows for t in found])[:-1].tolist()
    assert all(e in places for e in ends) and (size > 300 or len(found) > 3)
