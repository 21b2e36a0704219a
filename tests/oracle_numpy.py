"""Serial NumPy restatement of the training and evaluation rules, for tests only."""

import math


def logistic(x):
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def serial_pass(rows, theta=None, b=None, r=None, train=True, rule=None, eta=0.2, physical=True):
    """rows: dicts with learner, item, bundle, y, tags in execution order."""
    theta, b, r = dict(theta or {}), dict(b or {}), dict(r or {})
    runs, last = [], {}
    for i, row in enumerate(rows):
        key = (row["learner"], row["bundle"])
        if physical:
            if runs and runs[-1][0] == key:
                runs[-1][1].append(i)
            else:
                runs.append((key, [i]))
        else:
            at = last.get(row["learner"])
            if at is not None and runs[at][0] == key:
                runs[at][1].append(i)
            else:
                last[row["learner"]] = len(runs)
                runs.append((key, [i]))
    out = [None] * len(rows)
    for (learner, _), idx in runs:
        t = theta.get(learner, 0.0)
        bs = [b.get(rows[i]["item"], 0.0) for i in idx]
        ps = [logistic(t - x) for x in bs]
        ys = [rows[i]["y"] for i in idx]
        for i, x, p in zip(idx, bs, ps):
            known = [r.get((learner, k), 0.0) for k in rows[i]["tags"]]
            rbar = sum(known) / len(known) if known else 0.0
            out[i] = {"theta_pre": t, "b_pre": x, "p_global": p, "p_art": logistic(t - x + rbar), "r_bar": rbar}
        if train:
            for i, x, p, y in zip(idx, bs, ps, ys):
                b[rows[i]["item"]] = x + 0.02 * (-(y - p) - 1e-4 * x)
        theta[learner] = t + 0.05 * sum(y - p - 1e-4 * t for y, p in zip(ys, ps)) / len(idx)
        if rule == "token":
            e = sum(y - p for y, p in zip(ys, ps)) / len(idx)
            count = {}
            for i in idx:
                for k in rows[i]["tags"]:
                    count[k] = count.get(k, 0) + 1
            for k, n in count.items():
                r[learner, k] = (1 - eta) * r.get((learner, k), 0.0) + eta * e / n
        elif rule == "skill_mean":
            per = {}
            for i, p, y in zip(idx, ps, ys):
                per.setdefault(rows[i]["tags"][0], []).append(y - p)
            for k, errors in per.items():
                r[learner, k] = (1 - eta) * r.get((learner, k), 0.0) + eta * sum(errors) / len(errors)
    return out, theta, b, r
