"""Bundle models: the per-row and per-bundle steps that ``replay`` streams rows through.

A model scores each row from the state before its bundle, gathers what the
bundle reveals, and commits it once the bundle ends. Subclass ``BundleModel`` to
plug in a user model; the same class serves batch replay and the online query.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np

# Learning rates and shrinkage of the psychometric recipe.
THETA_LR = 0.05
B_LR = 0.02
L2 = 1e-4
ETA_R = 0.20

REQUIRED_METADATA = ("implementation", "checkpoint_format", "traversal", "oov_state", "execution_semantics")


def logistic(x: float) -> float:
    if x >= 0:
        return 1.0 / (1.0 + math.exp(-x))
    grown = math.exp(x)
    return grown / (1.0 + grown)


class BundleModel:
    """User surface. Override ``new_state``, ``score``, ``gather`` and ``commit``.

    ``columns`` are the row columns the model reads, ``outputs`` the columns that
    ``score`` returns, first of all the probability. States are stored as records
    ``(slot, values, clock, blob)``; the default pickles the whole state.
    """

    columns: tuple[str, ...] = ()
    outputs: tuple[tuple[str, str], ...] = (("probability", "double"),)
    slot_decay: float | None = None
    metadata: dict[str, str] = {}
    weighted: bool = False
    accepts_oov: tuple[str, ...] | None = None

    def new_state(self, key: Any) -> Any:
        raise NotImplementedError

    def score(self, state: Any, row: dict) -> tuple:
        raise NotImplementedError

    def gather(self, state: Any, gathered: Any, row: dict) -> Any:
        raise NotImplementedError

    def commit(self, state: Any, gathered: Any) -> Any:
        raise NotImplementedError

    def load(self, key: Any, records: list[tuple]) -> Any:
        return pickle.loads(records[0][3]) if records else self.new_state(key)

    def save(self, state: Any) -> list[tuple]:
        return [(-1, None, None, pickle.dumps(state, protocol=4))]

    def with_weight(self, column: str) -> "BundleModel":
        """Copy that reads pre-aggregated rows: ``correct`` is a sum over ``column`` equal rows."""
        raise NotImplementedError

    def head(self) -> "BundleModel":
        """Model of the main state alone, when the other slots do not feed back into it."""
        return self


def check_model(model: BundleModel, oov_semantics: str | None = None) -> None:
    """Plan-time contract check, before any row is read."""
    for name in ("new_state", "score", "gather", "commit"):
        if not callable(getattr(model, name, None)):
            raise TypeError(f"model lacks {name}()")
    missing = [n for n in REQUIRED_METADATA if not isinstance(model.metadata.get(n), str) or not model.metadata[n]]
    if missing:
        raise ValueError(f"model metadata lacks {missing}")
    if oov_semantics is not None and model.accepts_oov is not None and oov_semantics not in model.accepts_oov:
        raise ValueError(f"model does not accept out-of-vocabulary semantics {oov_semantics!r}")


class CountModel(BundleModel):
    """Probability falls with the number of revealed responses of the learner."""

    metadata = dict.fromkeys(REQUIRED_METADATA, "count-v1")

    def new_state(self, key):
        return 0

    def score(self, state, row):
        return (1.0 / (1.0 + state),)

    def gather(self, state, gathered, row):
        return (gathered or 0) + 1

    def commit(self, state, gathered):
        return state + gathered


@dataclass
class AbilityModel(BundleModel):
    """Ability with item difficulty given per row: one mean-gradient step per bundle."""

    theta_lr: float = THETA_LR
    l2: float = L2
    weight: str | None = None
    columns: tuple[str, ...] = ("b",)
    outputs: tuple[tuple[str, str], ...] = (
        ("probability", "double"), ("p_global", "double"), ("theta_pre", "double"), ("b_pre", "double"))
    metadata: dict = field(default_factory=lambda: dict.fromkeys(REQUIRED_METADATA, "ability-v1"))
    weighted = True

    def __post_init__(self):
        self.columns = ("b",) if self.weight is None else ("b", self.weight)

    def with_weight(self, column):
        return AbilityModel(self.theta_lr, self.l2, column)

    def load(self, key, records):
        return records[0][1][0] if records else 0.0

    def save(self, state):
        return [(-1, [state], None, None)]

    def score(self, state, row):
        p = logistic(state - row["b"])
        return p, p, state, row["b"]

    def gather(self, state, gathered, row):
        total, n = gathered or (0.0, 0)
        w = 1 if self.weight is None else row[self.weight]
        return total + (row["correct"] - w * (logistic(state - row["b"]) + self.l2 * state)), n + w

    def commit(self, state, gathered):
        return state + self.theta_lr * (gathered[0] / gathered[1])


@dataclass
class ResidualModel(BundleModel):
    """Ability plus one residual per learner and KC.

    ``rule`` is ``token`` (group error over the KC's token count in the bundle)
    or ``skill_mean`` (mean error of the KC's rows, exactly one KC per row).
    """

    rule: str = "token"
    eta: float = ETA_R
    theta_lr: float = THETA_LR
    l2: float = L2
    tags: str = "tag_idxs"
    clock: str = "timestamp"
    weight: str | None = None
    outputs: tuple[tuple[str, str], ...] = (
        ("probability", "double"), ("p_global", "double"), ("theta_pre", "double"), ("b_pre", "double"),
        ("r_bar", "double"), ("r_pre", "array<double>"))
    metadata: dict = field(default_factory=lambda: dict.fromkeys(REQUIRED_METADATA, "residual-v1"))

    def __post_init__(self):
        if self.rule not in ("token", "skill_mean"):
            raise ValueError(f"rule must be token or skill_mean, got {self.rule!r}")
        self.columns = ("b", self.tags, self.clock) + (() if self.weight is None else (self.weight,))
        self.slot_decay = 1.0 - self.eta

    weighted = True

    def with_weight(self, column):
        return replace(self, weight=column)

    def head(self):
        return AbilityModel(self.theta_lr, self.l2, self.weight)

    def load(self, key, records):
        theta, residual = 0.0, {}
        for slot, values, clock, _ in records:
            if slot < 0:
                theta = values[0]
            else:
                residual[slot] = (values[0], 0.0, clock)
        return theta, residual

    def save(self, state):
        theta, residual = state
        return [(-1, [theta], None, None)] + [(k, [r, n], clock, None) for k, (r, n, clock) in residual.items()]

    def score(self, state, row):
        theta, residual = state
        known = [residual[k][0] if k in residual else 0.0 for k in row[self.tags]]
        mean = sum(known) / len(known) if known else 0.0
        z = theta - row["b"]
        return logistic(z + mean), logistic(z), theta, row["b"], mean, known

    def gather(self, state, gathered, row):
        theta = state[0]
        w = 1 if self.weight is None else row[self.weight]
        error = row["correct"] - w * logistic(theta - row["b"])
        seen = gathered or {"error": 0.0, "n": 0, "kc": {}, "clock": None}
        seen["error"] += error
        first = seen["n"] == 0
        seen["n"] += w
        tags, when = row[self.tags], row[self.clock]
        when = None if when is None else int(when)
        if self.rule == "skill_mean" and len(tags) != 1:
            raise ValueError("skill_mean needs exactly one KC per row")
        if self.rule == "token":
            if when is not None:
                seen["clock"] = when if seen["clock"] is None else max(seen["clock"], when)
        elif first:
            seen["clock"] = when
        for k in tags:
            total, count = seen["kc"].get(k, (0.0, 0))
            seen["kc"][k] = (total + error, count + w)
        return seen

    def commit(self, state, gathered):
        theta, residual = state
        n, keep = gathered["n"], 1.0 - self.eta
        group_error = gathered["error"] / n
        for k, (total, count) in gathered["kc"].items():
            target = group_error / count if self.rule == "token" else total / count
            old, touches, _ = residual.get(k, (0.0, 0.0, None))
            residual[k] = (keep * old + self.eta * target, touches + 1.0, gathered["clock"])
        return theta + self.theta_lr * (group_error - self.l2 * theta), residual


@dataclass
class DifficultyModel(BundleModel):
    """Item difficulty with the learner's ability given per row (training side).

    Rows of one run share the difficulty; the run's last row decides the step,
    so ``last`` names the column with the response that counts.
    """

    b_lr: float = B_LR
    l2: float = L2
    last: str = "correct"
    columns: tuple[str, ...] = ("theta_pre",)
    outputs: tuple[tuple[str, str], ...] = (("b_new", "double"),)

    def __post_init__(self):
        self.columns = ("theta_pre", self.last)

    def load(self, key, records):
        return records[0][1][0] if records else 0.0

    def save(self, state):
        return [(-1, [state], None, None)]

    def score(self, state, row):
        return (state,)

    def gather(self, state, gathered, row):
        return row[self.last] - logistic(row["theta_pre"] - state)

    def commit(self, state, gathered):
        return state + self.b_lr * (-gathered - self.l2 * state)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    small = np.exp(-np.abs(x))
    return np.where(x >= 0, 1.0 / (1.0 + small), small / (1.0 + small))


class RecurrentModel(BundleModel):
    """LSTM scoring with fixed weights; with KC embeddings the input gains their mean.

    ``weights``: interaction_emb [2Q, D], w_ih [4H, D], w_hh [4H, H], b_ih, b_hh
    [4H] (gate order input, forget, cell, output), out_w [Q, H], out_b [Q], and
    optionally kc_emb [2K, D].
    """

    outputs = (("probability", "double"), ("logit", "double"), ("hidden_pre", "array<double>"))
    metadata = dict.fromkeys(REQUIRED_METADATA, "recurrent-v1")

    def __init__(self, weights: dict[str, np.ndarray], item: str = "problem_idx", tags: str = "tag_idxs"):
        self.weights = {k: np.asarray(v, dtype=np.float64) for k, v in weights.items()}
        self.item, self.tags = item, tags
        self.columns = (item, tags) if "kc_emb" in weights else (item,)

    def load(self, key, records):
        size = self.weights["w_hh"].shape[1]
        if not records:
            return np.zeros(size), np.zeros(size)
        stored = np.asarray(records[0][1], dtype=np.float64)
        return stored[:size], stored[size:]

    def save(self, state):
        return [(-1, np.concatenate(state).tolist(), None, None)]

    def score(self, state, row):
        at = row[self.item]
        logit = float(self.weights["out_w"][at] @ state[0] + self.weights["out_b"][at])
        return logistic(logit), logit, state[0].tolist()

    def _input(self, row):
        w = self.weights
        y = int(row["correct"])
        x = w["interaction_emb"][row[self.item] + w["out_w"].shape[0] * y]
        if "kc_emb" in w and row[self.tags]:
            half = w["kc_emb"].shape[0] // 2
            x = x + w["kc_emb"][[k + half * y for k in row[self.tags]]].mean(axis=0)
        return x

    def gather(self, state, gathered, row):
        w = self.weights
        h, c = state if gathered is None else gathered
        gates = w["w_ih"] @ self._input(row) + w["b_ih"] + w["w_hh"] @ h + w["b_hh"]
        size = h.shape[0]
        i, f, o = (_sigmoid(gates[k * size:(k + 1) * size]) for k in (0, 1, 3))
        c = f * c + i * np.tanh(gates[2 * size:3 * size])
        return o * np.tanh(c), c

    def commit(self, state, gathered):
        return gathered


class MemoryModel(BundleModel):
    """Key-value memory scoring; reads use the memory before the bundle, writes go row by row.

    ``weights``: key_emb [Q, D], slots [M, D], memory0 [M, D], value_emb [2Q, D],
    erase_w [D, D], erase_b, add_w [D, D], add_b, mix_w [D, 2D], mix_b, out_w [D],
    out_b [1], and optionally kc_emb [K, D] whose mean is added to the read.
    """

    outputs = (("probability", "double"), ("logit", "double"), ("memory_sum", "double"))
    metadata = dict.fromkeys(REQUIRED_METADATA, "memory-v1")

    def __init__(self, weights: dict[str, np.ndarray], item: str = "problem_idx", tags: str = "tag_idxs"):
        self.weights = {k: np.asarray(v, dtype=np.float64) for k, v in weights.items()}
        self.item, self.tags = item, tags
        self.columns = (item, tags) if "kc_emb" in weights else (item,)

    def load(self, key, records):
        if not records:
            return self.weights["memory0"]
        return np.asarray(records[0][1], dtype=np.float64).reshape(self.weights["memory0"].shape)

    def save(self, state):
        return [(-1, state.ravel().tolist(), None, None)]

    def _attention(self, row):
        match = self.weights["slots"] @ self.weights["key_emb"][row[self.item]]
        grown = np.exp(match - match.max())
        return grown / grown.sum()

    def score(self, state, row):
        w = self.weights
        read = self._attention(row) @ state
        if "kc_emb" in w and row[self.tags]:
            read = read + w["kc_emb"][row[self.tags]].mean(axis=0)
        mixed = np.tanh(w["mix_w"] @ np.concatenate([read, w["key_emb"][row[self.item]]]) + w["mix_b"])
        logit = float(w["out_w"] @ mixed + w["out_b"][0])
        return logistic(logit), logit, float(state.sum())

    def gather(self, state, gathered, row):
        w = self.weights
        memory = state if gathered is None else gathered
        value = w["value_emb"][row[self.item] + w["key_emb"].shape[0] * int(row["correct"])]
        erase = _sigmoid(w["erase_w"] @ value + w["erase_b"])
        add = np.tanh(w["add_w"] @ value + w["add_b"])
        focus = self._attention(row)[:, None]
        return memory * (1.0 - focus * erase) + focus * add

    def commit(self, state, gathered):
        return gathered
