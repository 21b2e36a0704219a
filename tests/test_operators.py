import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenseq.functions import scalars as S
from lumenseq.operators import align, identity as I, layout, metrics as M, sampling as A, sequence as Q, splits as P, validate as L, vocab as V, windows as W
from lumenseq.operators import replay as R
from lumenseq.operators.layout import Running, hot_keys, ordinal, scan
from lumenseq.operators.models import MemoryModel, RecurrentModel, check_model, CountModel, BundleModel
from lumenseq.plans.model_queries import memory_weights, recurrent_weights
from lumenseq.sources.files import toy_interactions


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("5;2;182", [5, 2, 182]), ("-1", []), ("", []), (None, []), (" 5; ;2;5 ", [5, 2, 5])])
def test_tags(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(S.parse_tags("t").alias("x")).first()["x"] == want


@pytest.mark.parametrize("text", ["5;-1;2", "a", "5;2.0"])
def test_bad_tags(spark, text):
    df = spark.createDataFrame([(text, "q9")], "t string, q string")
    with pytest.raises(Exception, match="question q9"):
        df.select(S.parse_tags("t", "q")).collect()


def test_scalars(spark):
    assert one(spark, S.cell(F.lit("  x\x1c "))) == "x"
    assert one(spark, S.solving_of_bundle(F.lit("u1"), F.lit("u1|12"))) == 12
    assert one(spark, S.solving_of_bundle(F.lit("u1"), F.lit("u2|12"))) is None
    assert one(spark, S.source_row_of_id(F.lit("u:1:7"))) == 7
    assert one(spark, S.mean_or_zero(F.array(F.lit(1.0), F.lit(1.0), F.lit(4.0)))) == 2.0
    assert [one(spark, S.is_kc_token(F.lit(t))) for t in ("0", "-3", "03", "-0", "7")] == [True, True, False, False, True]
    for n, want in ((1, (1, 0, 0)), (2, (1, 0, 1)), (6, (4, 1, 1)), (35, (24, 4, 7)), (5, (4, 0, 1))):
        train, valid = S.short_history_cut(F.lit(n).cast("long"))
        got = spark.range(1).select(train.alias("t"), valid.alias("v")).first()
        if n != 5:
            assert (got.t, got.v, n - got.t - got.v) == want
        assert got.t == max(1, round(n * 0.7))


@pytest.mark.parametrize("width", [3, 10_000])
def test_scan_slices_agree_with_brute_force(spark, width):
    rows = [("a" if i % 3 else f"k{i % 5}", i - 20, None if i % 4 == 0 else i * 7 % 11) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(5)
    hot = hot_keys(df, ["k"], width)
    specs = [Running("s", "sum", F.col("v")), Running("c", "count"), Running("l", "last", F.col("v")),
             Running("m", "max", F.col("v"), inclusive=True), Running("n", "min", F.col("v"), inclusive=True)]
    got = {r["o"]: r for r in scan(df, ["k"], "o", specs, hot).collect()}
    for k, o, v in rows:
        before = [x for x in rows if x[0] == k and x[1] < o]
        upto = [x[2] for x in rows if x[0] == k and x[1] <= o and x[2] is not None]
        known = [x[2] for x in before if x[2] is not None]
        assert got[o]["s"] == sum(known) and got[o]["c"] == len(before)
        assert got[o]["l"] == (known[-1] if known else None)
        assert got[o]["m"] == (max(upto) if upto else None) and got[o]["n"] == (min(upto) if upto else None)


def test_ordinal_and_densify(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("x"), (F.col("id") % 7).alias("y")).repartition(6)
    got = sorted((r["y"], r["x"], r["seq"]) for r in ordinal(df, ["y", "x"]).collect())
    assert [g[2] for g in got] == list(range(1000))
    sparse = spark.range(0, 5_000_000, 1_700_001).select(F.col("id").alias("seq"))
    assert sorted(r["seq"] for r in layout.densify(sparse).collect()) == [0, 1, 2]


def test_fractional_split_interleaved_bundle(spark):
    rows = [(i, "u", b) for i, b in enumerate(["B1", "B2", "B1"])]
    df = spark.createDataFrame(rows, "seq long, learner_id string, bundle_id string").withColumn("split", F.lit(None).cast("string"))
    got = [r["split"] for r in P.fractional_bundle_split(df, 0.5, 0.0).orderBy("seq").collect()]
    assert got == ["train", "test", "train"]
    with pytest.raises(ValueError):
        P.fractional_bundle_split(df, 0.9, 0.2)


def test_solving_split_numeric_order(spark):
    rows = [(i, "u", s) for i, s in enumerate([9, 1, 2, 3, 4, 5])]
    df = spark.createDataFrame(rows, "seq long, learner_id string, solving_id long").withColumn("split", F.lit(None).cast("string"))
    got = {r["solving_id"]: r["split"] for r in P.solving_split(df).collect()}
    assert got == {1: "train", 2: "train", 3: "train", 4: "train", 5: "valid", 9: "test"}


def test_sampler_goldens(spark):
    small = spark.createDataFrame([(f"u{i}",) for i in range(10)], "u string")
    large = spark.createDataFrame([(f"u{i:03d}",) for i in range(100)], "u string")
    assert sorted(r["u"] for r in A.seeded_sample(small, "u", 3, 42).collect()) == ["u0", "u1", "u4"]
    assert sorted(r["u"] for r in A.seeded_sample(large, "u", 6, 42).collect()) == ["u003", "u014", "u031", "u035", "u081", "u094"]
    with pytest.raises(ValueError):
        A.first_ids(small, "u", 11)


def test_metric_rules(spark):
    def score(pairs):
        df = spark.createDataFrame([(y, p, True) for y, p in pairs], "correct long, probability double, metric_mask boolean")
        return M.masked_metrics(df).first()
    got = score([(1, 0.0), (0, 1.0)])
    assert got["brier"] == 1.0 and got["nll"] == pytest.approx(-np.log(1e-12), rel=1e-4)
    assert score([(1, 0.2), (1, 0.9)])["auc"] == 0.5
    assert score([(0, 0.2), (1, 0.4), (1, 0.4)])["auc"] == 1.0
    masked = spark.createDataFrame([(1, 0.5, False)], "correct long, probability double, metric_mask boolean")
    assert M.masked_metrics(masked).count() == 0
    gate = M.within_tolerance(M.masked_metrics(spark.createDataFrame([(1, 0.5, True), (0, 0.5, True)], masked.schema)), {"nll": np.log(2), "brier": 0.25, "auc": 0.5})
    assert gate.first()["ok"]
    epochs = spark.createDataFrame([(0, e, a) for e, a in enumerate([0.5, 0.6, 0.6005, 0.59, 0.7])], "run long, epoch long, auc double")
    track = M.early_stop(epochs, 0.001, 2).orderBy("epoch").collect()
    assert [r["epoch"] for r in track] == [0, 1, 2, 3] and track[-1]["stop"] and track[-1]["best_epoch"] == 1


def test_row_json_matches_python(spark):
    odd = 'q"\\ é中 \x0b\x1f\n\t \\u000B'
    toy = toy_interactions(spark).withColumn("item_id", F.lit(odd)).withColumn("timestamp", F.when(F.col("seq") == 1, 0.1).when(F.col("seq") == 2, F.lit(None)).otherwise(F.col("timestamp")))
    got = {r["seq"]: r["j"] for r in toy.select("seq", I.row_json(toy).alias("j")).collect()}
    text = json.loads(got[0])
    assert list(text) == ["interaction_id", "learner_id", "item_id", "correct", "kc_ids", "order", "timestamp", "bundle_id", "split", "metric_mask"]
    assert json.dumps(odd, ensure_ascii=False) in got[0] and '"timestamp":50,' in got[0]
    assert '"timestamp":1.0000000000000001e-01,' in got[1] and '"timestamp":null,' in got[2]
    plain = toy_interactions(spark)
    lines = [r["j"] for r in plain.select("seq", I.row_json(plain).alias("j")).orderBy("seq").collect()]
    assert [json.loads(x)["interaction_id"] for x in lines] == [r["interaction_id"] for r in plain.orderBy("seq").collect()]


def test_tree_hash_sensitivity(spark, small_hot):
    toy = toy_interactions(spark)
    of = lambda df: {r["split"]: (r["tree_hash"], r["row_count"]) for r in I.tree_hash(df, I.row_json(df), "split").collect()}
    base = of(toy)
    assert of(toy.repartition(3)) == base
    swapped = toy.withColumn("seq", F.when(F.col("seq") == 0, 1).when(F.col("seq") == 1, 0).otherwise(F.col("seq")).cast("long"))
    assert of(swapped)["train"] != base["train"] and of(swapped)["valid"] == base["valid"]
    for column, value in (("bundle_id", F.lit("z")), ("metric_mask", F.lit(False)), ("kc_ids", F.reverse("kc_ids"))):
        assert of(toy.withColumn(column, value))["train"] != base["train"]


def test_identity_documents():
    text, digest = I.dataset_identity("d", "p", "v", None, [("train", "0" * 64, 3)], "1" * 64, None)
    assert '"cohort_hash":null' in text and digest == hashlib.sha256(text.encode()).hexdigest()
    other, _ = I.contract_identity(digest, "s", "b", "o", "m", [("train", "train")])
    assert list(json.loads(other))[:2] == ["contract_identity_version", "dataset_logical_hash"]


def test_validation_toy_and_switches(spark):
    toy = toy_interactions(spark)
    assert L.is_valid(toy)
    back = toy.withColumn("timestamp", F.when(F.col("seq") == 3, 1.0).otherwise(F.col("timestamp")))
    assert [r["code"] for r in L.validate(back).collect()] == ["temporal_regression"]
    assert L.is_valid(back, check_temporal=False)
    assert [r["interaction_id"] for r in L.repeated_kc_report(toy.withColumn("kc_ids", F.array(F.lit(1).cast("long"), F.lit(1).cast("long")))).limit(1).collect()] == ["ann-0"]


def test_encode_kcs_unknown(spark):
    rows = spark.createDataFrame([(0, [3, 9, 3]), (1, [])], "seq long, kc_ids array<long>")
    vocab = spark.createDataFrame([(3, 0)], "id long, idx long")
    assert [r["tag_idxs"] for r in V.encode_kcs(rows, vocab).orderBy("seq").collect()] == [[0, 0], []]
    with pytest.raises(Exception, match="kc not in vocabulary"):
        V.encode_kcs(rows, vocab, unknown="error").collect()


def test_alignment(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "seq long, interaction_id string")
    out = spark.createDataFrame([(0, "a"), (2, "b"), (3, "d"), (4, "a")], rows.schema)
    got = {r["interaction_id"]: r["problem"] for r in align.misaligned(rows, out).collect()}
    assert got == {"a": "duplicate", "b": "reordered", "c": "missing", "d": "extra"}
    with pytest.raises(TypeError):
        check_model(type("Bad", (), {"metadata": {}})())
    with pytest.raises(ValueError):
        check_model(BundleModel())


def test_parity_window_against_serial_search(spark):
    rng = np.random.default_rng(5)
    n = 90
    who = np.repeat(rng.integers(0, 3, n // 3), 3)
    data = [(i, f"u{who[i]}", f"b{rng.integers(0, 2)}", f"q{rng.integers(0, 6)}", int(rng.integers(0, 2)),
             [int(k) for k in rng.integers(0, 4, rng.integers(0, 4))], i % 31 == 4) for i in range(n)]
    df = spark.createDataFrame(data, "seq long, learner_id string, bundle_id string, item_id string, correct long, tags array<long>, sentinel boolean")
    starts = [i for i in range(n) if i == 0 or data[i][1:3] != data[i - 1][1:3]] + [n]
    spans = list(zip(starts, starts[1:]))

    def complete(lo, hi):
        rows = data[lo:hi]
        runs = [data[a:b] for a, b in spans if lo <= a and b <= hi]
        count = lambda xs: max([xs.count(x) for x in xs], default=0)
        exposures = [k for r in runs for k in {t for row in r for t in row[5]}]
        return (any(len(r) == 1 for r in runs) and any(len(r) > 1 for r in runs) and count([r[0][1:3] for r in runs]) > 1
                and count([r[3] for r in rows]) > 1 and {r[4] for r in rows} == {0, 1} and len({r[1] for r in rows}) > 1
                and any(len(r[5]) > 1 for r in rows) and any(len(r[5]) != len(set(r[5])) for r in rows) and count(exposures) > 1)

    want, start = None, 0
    for a, b in spans:
        if any(r[6] for r in data[a:b]):
            start = b
        elif complete(start, b):
            want = (start, b)
            break
    got = Q.parity_window(W.runs(df, physical=True)).collect()
    assert [(r["start"], r["end"]) for r in got] == ([want] if want else [])


def sequence_rows(spark, items=6, kcs=4, n=60):
    rng = np.random.default_rng(2)
    learners = sorted(int(x) for x in rng.integers(0, 4, n))
    data = [(i, f"u{u}", f"b{i // 3}", int(rng.integers(0, 2)), int(rng.integers(0, items)), [int(k) for k in rng.integers(0, kcs, rng.integers(0, 3))])
            for i, u in enumerate(learners)]
    return data, spark.createDataFrame([(*r, f"i{r[0]}") for r in data], "seq long, learner_id string, bundle_id string, correct long, problem_idx long, tag_idxs array<long>, interaction_id string")


@pytest.mark.parametrize("kc", [False, True])
def test_recurrent_replay_matches_plain_loop(spark, kc):
    data, df = sequence_rows(spark)
    w = recurrent_weights(6, 4, kc=kc)
    got = {r["seq"]: r["probability"] for r in R.trace_of(R.replay(df, RecurrentModel(w))).collect()}
    sig = lambda x: 1 / (1 + np.exp(-x))
    size = w["w_hh"].shape[1]
    state, pre, last = {}, {}, {}
    for seq, u, b, y, q, tags in data:
        h, c = state.get(u, (np.zeros(size), np.zeros(size)))
        if last.get(u) != b:
            pre[u], last[u] = h, b
        assert got[seq] == pytest.approx(sig(w["out_w"][q] @ pre[u] + w["out_b"][q]), abs=1e-12)
        x = w["interaction_emb"][q + 6 * y] + (np.mean([w["kc_emb"][k + 4 * y] for k in tags], axis=0) if kc and tags else 0)
        i, f, g, o = np.split(w["w_ih"] @ x + w["b_ih"] + w["w_hh"] @ h + w["b_hh"], 4)
        c = sig(f) * c + sig(i) * np.tanh(g)
        state[u] = (sig(o) * np.tanh(c), c)


@pytest.mark.parametrize("kc", [False, True])
def test_memory_replay_matches_plain_loop(spark, kc):
    data, df = sequence_rows(spark)
    w = memory_weights(6, 4, kc=kc)
    got = {r["seq"]: r["probability"] for r in R.trace_of(R.replay(df, MemoryModel(w))).collect()}
    sig = lambda x: 1 / (1 + np.exp(-x))
    state, pre, last = {}, {}, {}
    for seq, u, b, y, q, tags in data:
        memory = state.get(u, w["memory0"])
        if last.get(u) != b:
            pre[u], last[u] = memory, b
        e = np.exp(w["slots"] @ w["key_emb"][q])
        a = e / e.sum()
        read = a @ pre[u] + (w["kc_emb"][tags].mean(axis=0) if kc and tags else 0)
        f = np.tanh(w["mix_w"] @ np.r_[read, w["key_emb"][q]] + w["mix_b"])
        assert got[seq] == pytest.approx(sig(w["out_w"] @ f + w["out_b"][0]), abs=1e-12)
        v = w["value_emb"][q + 6 * y]
        state[u] = memory * (1 - np.outer(a, sig(w["erase_w"] @ v + w["erase_b"]))) + np.outer(a, np.tanh(w["add_w"] @ v + w["add_b"]))


def test_current_label_never_changes_its_own_score(spark):
    data, df = sequence_rows(spark)
    w = recurrent_weights(6, 4)
    score = lambda d: {r["seq"]: r["probability"] for r in R.trace_of(R.replay(d, RecurrentModel(w))).collect()}
    base = score(df)
    bundle = [r[0] for r in data if r[1:3] == data[0][1:3]]
    flipped = score(df.withColumn("correct", F.when(F.col("seq") == 0, 1 - F.col("correct")).otherwise(F.col("correct"))))
    assert all(base[s] == flipped[s] for s in bundle) and base != flipped
    none = score(df.withColumn("tag_idxs", F.array().cast("array<bigint>")))
    assert none == base


def test_canonical_rows_are_made_once_and_joined_to_the_items_they_name(spark, tmp_path):
    """Splits and numbers come from stored rows, not from the raw log again; catalog entries that no row names stay out of the join."""
    from lumenseq.plans.tables import Kt1

    data = "/root/testdata/sf0.001"
    for name in ("events", "part"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    k = Kt1(spark, str(tmp_path))
    assert not [f for f in k.split.inputFiles() if "/events.parquet/" in f]
    named = {r[0] for r in k._events.select("question_id").distinct().collect()}
    whole = {r["question_id"] for r in k.catalog.collect()}
    assert {r["question_id"] for r in k.asked.collect()} == named & whole < whole


def test_ordinal_writes_the_named_columns_only(spark):
    df = spark.createDataFrame([(c, 9 - c, str(c)) for c in (5, 1, 7, 3)], "a long, b long, t string")
    numbered = ordinal(df, ["a"], "n", ["t"])
    assert sorted(tuple(r) for r in numbered.collect()) == [("1", 0), ("3", 1), ("5", 2), ("7", 3)]
    written = spark.read.parquet(*numbered.inputFiles()[:1])
    assert set(written.columns) == {"t", "_id"}
