import random

import pytest
from pyspark.sql import functions as F

from lumenseq.operators import replay as R
from lumenseq.operators.fit import train
from lumenseq.operators.models import AbilityModel, CountModel, ResidualModel
from oracle_numpy import serial_pass

SCHEMA = "seq long, interaction_id string, learner_id string, item_id string, bundle_id string, correct long, tag_idxs array<long>, timestamp long, metric_mask boolean, b double"


def log(n=120, learners=5, items=9, kcs=4, seed=3, one_kc=False, skew=0.5, contiguous=True):
    rng = random.Random(seed)
    who = ["u0" if rng.random() < skew else f"u{rng.randrange(1, learners)}" for _ in range(n)]
    if contiguous:
        who.sort()
    rows, bundle = [], {}
    for i, u in enumerate(who):
        if rng.random() < 0.5:
            bundle[u] = bundle.get(u, 0) + 1
        tags = [rng.randrange(kcs)] if one_kc else [rng.randrange(kcs) for _ in range(rng.randrange(4))]
        item = 0 if rng.random() < 0.3 else rng.randrange(items)
        rows.append(dict(seq=i, learner=u, item=f"q{item}", bundle=f"{u}|{bundle.get(u, 0)}", y=rng.randrange(2), tags=tags, b=0.1 * item - 0.4))
    return rows


def frame(spark, rows):
    data = [(r["seq"], f"i{r['seq']}", r["learner"], r["item"], r["bundle"], r["y"], r["tags"], r["seq"] * 10, True, r["b"]) for r in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3, "item_id")


def got(walked):
    return {r["seq"]: r for r in R.trace_of(walked).collect()}


def test_worked_token_rule(spark):
    """Bundles, multiplicities and first residuals of a hand-checked six-row log."""
    spec = [(0, 0, 1, 1, (0, 1, 0)), (0, 1, 1, 1, (2,)), (0, 0, 2, 1, (0, 1, 0))]
    rows = [dict(seq=i, learner=f"u{s}", item=f"q{q}", bundle=str(g), y=y, tags=list(t), b=0.0) for i, (s, q, g, y, t) in enumerate(spec)]
    out = got(R.replay(frame(spark, rows), ResidualModel()))
    assert out[0]["probability"] == 0.5 and out[0]["r_pre"] == [0.0, 0.0, 0.0]
    assert out[2]["r_pre"] == pytest.approx([0.05, 0.1, 0.05], abs=1e-15)
    assert out[2]["r_bar"] == pytest.approx((0.05 + 0.1 + 0.05) / 3, abs=1e-15)
    assert out[2]["theta_pre"] == pytest.approx(0.025)


@pytest.mark.parametrize("rule", ["token", "skill_mean"])
def test_eval_matches_serial(spark, rule):
    rows = log(one_kc=rule == "skill_mean")
    want, theta, _, r = serial_pass(rows, b={x["item"]: x["b"] for x in rows}, train=False, rule=rule)
    walked = R.replay(frame(spark, rows), ResidualModel(rule=rule))
    out = got(walked)
    for x in rows:
        for name, mine in (("p_global", "p_global"), ("p_art", "probability"), ("theta_pre", "theta_pre"), ("r_bar", "r_bar")):
            assert out[x["seq"]][mine] == pytest.approx(want[x["seq"]][name], abs=1e-12)
    states = {(s["learner_id"], s["slot"]): s["values"][0] for s in R.states_of(walked).collect()}
    assert all(states[u, -1] == pytest.approx(t, abs=1e-12) for u, t in theta.items())
    assert all(states[k] == pytest.approx(v, abs=1e-12) for k, v in r.items())


@pytest.mark.parametrize("rule", ["token", "skill_mean"])
def test_hot_learner_lanes_match_serial(spark, small_hot, rule):
    rows = log(n=90, one_kc=rule == "skill_mean")
    want, theta, _, r = serial_pass(rows, b={x["item"]: x["b"] for x in rows}, train=False, rule=rule)
    walked = R.replay(frame(spark, rows), ResidualModel(rule=rule), tolerance=1e-15)
    out = got(walked)
    for x in rows:
        assert out[x["seq"]]["probability"] == pytest.approx(want[x["seq"]]["p_art"], abs=1e-12)
    states = {(s["learner_id"], s["slot"]): s["values"][0] for s in R.states_of(walked).collect()}
    assert all(states[k] == pytest.approx(v, abs=1e-12) for k, v in r.items())


def test_user_model_in_lanes(spark, small_hot):
    rows = log(n=60)
    want = {r["interaction_id"]: 1.0 / (1 + r["pre_bundle_update_count"]) for r in
            R.bundle_pre_state(frame(spark, rows).withColumn("order", F.col("seq"))).collect()}
    out = got(R.replay(frame(spark, rows), CountModel()))
    assert {r["interaction_id"]: r["probability"] for r in out.values()} == pytest.approx(want)


def test_chained_states_equal_uninterrupted(spark):
    rows = log()
    cut = next(i for i in range(1, len(rows)) if rows[i]["learner"] != rows[i - 1]["learner"]) // 2
    while rows[cut]["bundle"] == rows[cut - 1]["bundle"]:
        cut += 1
    df = frame(spark, rows)
    whole = got(R.replay(df, ResidualModel()))
    first = R.replay(df.where(F.col("seq") < cut), ResidualModel())
    rest = got(R.replay(df.where(F.col("seq") >= cut), ResidualModel(), R.states_of(first)))
    assert all(rest[k]["probability"] == whole[k]["probability"] for k in rest)


@pytest.mark.parametrize("contiguous", [True, False])
def test_training_matches_serial(spark, contiguous):
    rows = log(n=120, contiguous=contiguous)
    want, theta, b, r = serial_pass(rows, train=True, rule="token")
    fit = train(frame(spark, rows).drop("b"), residual=ResidualModel())
    out = got(fit.walked)
    assert fit.step <= 1e-13
    for x in rows:
        assert out[x["seq"]]["p_global"] == pytest.approx(want[x["seq"]]["p_global"], abs=1e-12)
        assert out[x["seq"]]["probability"] == pytest.approx(want[x["seq"]]["p_art"], abs=1e-12)
    assert {i["item_id"]: i["b"] for i in fit.difficulty.collect()} == pytest.approx(b, abs=1e-12)


def test_training_duplicate_item_last_write(spark):
    rows = [dict(seq=0, learner="u", item="q", bundle="7", y=1, tags=[], b=0.0), dict(seq=1, learner="u", item="q", bundle="7", y=0, tags=[], b=0.0)]
    fit = train(frame(spark, rows).drop("b"))
    assert fit.difficulty.first()["b"] == pytest.approx(0.02 * 0.5)


def test_training_hot_keys(spark):
    from lumenseq.session import HOT_ROWS_SETTING
    rows = log(n=60)
    want, *_ = serial_pass(rows, train=True)
    spark.conf.set(HOT_ROWS_SETTING, "25")
    try:
        fit = train(frame(spark, rows).drop("b"))
    finally:
        spark.conf.unset(HOT_ROWS_SETTING)
    out = got(fit.walked)
    for x in rows:
        assert out[x["seq"]]["p_global"] == pytest.approx(want[x["seq"]]["p_global"], abs=1e-11)


def test_training_of_one_slice_is_one_pass(spark):
    """A short log is one slice, and a slice is one ordered pass; sweeps by learner and by item took several."""
    rows = log(n=120)
    _, _, b, _ = serial_pass(rows, train=True)
    fit = train(frame(spark, rows).drop("b"))
    assert fit.sweeps == 1
    assert {i["item_id"]: i["b"] for i in fit.difficulty.collect()} == pytest.approx(b, abs=1e-14)


@pytest.mark.parametrize("contiguous,physical", [(True, True), (False, True), (False, False)])
def test_training_in_slices(spark, contiguous, physical):
    """Twelve slices of ten rows, with learners and items that cross them, initial states and numbered items."""
    from lumenseq.session import HOT_ROWS_SETTING
    rows = log(n=120, contiguous=contiguous)
    theta, b = {"u0": 0.4, "u1": -0.3}, {"q0": 0.2, "q3": -0.5, "q99": 1.0}
    want, _, b_post, _ = serial_pass(rows, theta, b, train=True, physical=physical)
    number = F.substring("item_id", 2, 9).cast("long").alias("item_id")
    known = spark.createDataFrame(list(b.items()), "item_id string, b double").select(number, "b")
    states = spark.createDataFrame([(u, -1, [t], None, None) for u, t in theta.items()], "learner_id string, " + R.STATE_SCHEMA)
    df = frame(spark, rows).drop("b").withColumn("item_id", number)
    none = R.hot_keys(df, ["learner_id"])
    spark.conf.set(HOT_ROWS_SETTING, "10")
    try:
        fit = train(df, known, states, physical=physical, learner_hot=none)
    finally:
        spark.conf.unset(HOT_ROWS_SETTING)
    assert 1 < fit.sweeps <= 13
    seen = {r["seq"]: r["b"] for r in fit.rows.collect()}
    assert seen == pytest.approx({x["seq"]: want[x["seq"]]["b_pre"] for x in rows}, abs=1e-12)
    assert {f"q{i['item_id']}": i["b"] for i in fit.difficulty.collect()} == pytest.approx(b_post, abs=1e-12)
    if physical:
        out = got(fit.walked)
        assert all(out[x["seq"]]["p_global"] == pytest.approx(want[x["seq"]]["p_global"], abs=1e-12) for x in rows)


@pytest.mark.parametrize("rule", ["token", "skill_mean", None])
def test_one_huge_bundle(spark, small_hot, rule):
    """A bundle above the threshold is folded to weighted rows and still scored row by row."""
    rows = log(n=70, one_kc=rule == "skill_mean")
    mine = [r for r in rows if r["learner"] == "u0"]
    for r in mine[5:30]:
        r["bundle"] = "u0|big"
    want, _, _, r = serial_pass(rows, b={x["item"]: x["b"] for x in rows}, train=False, rule=rule)
    model = ResidualModel(rule=rule) if rule else AbilityModel()
    walked = R.replay(frame(spark, rows), model, tolerance=1e-15)
    out = got(walked)
    assert len(out) == len(rows)
    for x in rows:
        assert out[x["seq"]]["probability"] == pytest.approx(want[x["seq"]]["p_art"], abs=1e-12)
        assert out[x["seq"]]["interaction_id"] == f"i{x['seq']}"
    states = {(s["learner_id"], s["slot"]): s["values"][0] for s in R.states_of(walked).collect()}
    assert all(states[k] == pytest.approx(v, abs=1e-12) for k, v in r.items())
