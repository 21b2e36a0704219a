"""Registered queries over the stateful models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenseq.operators import align, sequence
from lumenseq.operators import identity as I
from lumenseq.operators import metrics as M
from lumenseq.operators import replay as R
from lumenseq.operators import vocab as V
from lumenseq.operators import windows as W
from lumenseq.operators.fit import train
from lumenseq.operators.fitted import ItemRateModel
from lumenseq.operators.models import AbilityModel, CountModel, MemoryModel, RecurrentModel, ResidualModel, check_model
from lumenseq.plans import workflows
from lumenseq.plans.catalog import _AUC, _AUC_OUT, _COUNT, metric_columns, query, rounded, scored_rows
from lumenseq.plans.oracle import KT1, SIGMOID, TUTOR, number
from lumenseq.plans.tables import Kt1, Tutor
from lumenseq.session import cut_lineage, scratch_path


def item_number() -> Column:
    return F.substring("item_id", 2, 20).cast("long")


def with_difficulty(rows: DataFrame, k: Kt1) -> DataFrame:
    """Fixed item difficulties in [-0.5, 0.5] so that evaluation has a known table."""
    table = k.catalog.select(F.col("question_id").alias("item_id")).select("item_id", ((F.pmod(item_number() * 7, F.lit(11)) - 5) / 10.0).alias("b"))
    return R.attach_difficulty(rows, table)


_RUNS = KT1 + """
, rr AS (SELECT *, (item_no * 7 % 11 - 5) / 10.0e0 AS b, item_no % 7 AS one_kc FROM contig),
runs AS (SELECT learner_id, dense_rank() OVER (PARTITION BY learner_id ORDER BY solving_id) - 1 AS rn, solving_id,
         list(struct_pack(y := correct, b := b, k := one_kc)) AS items, flatten(list(kc_ids)) AS toks
         FROM rr GROUP BY learner_id, solving_id)"""
_ERR = "x.y - " + SIGMOID.format("rec.theta - x.b")
_IRT = _RUNS + f"""
, rec AS (
  SELECT DISTINCT learner_id, CAST(0 AS BIGINT) AS rn, 0.0e0 AS theta FROM runs
  UNION ALL
  SELECT rec.learner_id, rec.rn + 1, rec.theta + 0.05e0 * (list_avg(list_transform(runs.items, lambda x: {_ERR})) - 1e-4 * rec.theta)
  FROM rec JOIN runs ON runs.learner_id = rec.learner_id AND runs.rn = rec.rn),
pred AS (
  SELECT rr.*, rec.theta, {SIGMOID.format("rec.theta - rr.b")} AS p
  FROM rr JOIN runs USING (learner_id, solving_id) JOIN rec ON rec.learner_id = runs.learner_id AND rec.rn = runs.rn)
"""


@query("irt_eval", _IRT + "SELECT interaction_id, " + number("theta") + " AS theta_pre, " + number("p") + " AS probability FROM pred")
def irt_eval(spark, d):
    k = Kt1(spark, d)
    trace = R.trace_of(R.replay(with_difficulty(k.contiguous, k), AbilityModel(), hot=k.hot))
    return trace.select("interaction_id", rounded("theta_pre").alias("theta_pre"), rounded("probability").alias("probability"))


@query("irt_final_state", _IRT + """
SELECT learner_id, """ + number("theta") + """ AS theta FROM rec QUALIFY row_number() OVER (PARTITION BY learner_id ORDER BY rn DESC) = 1""")
def irt_final_state(spark, d):
    k = Kt1(spark, d)
    walked = R.replay(with_difficulty(k.contiguous, k), AbilityModel(), hot=k.hot)
    return R.states_of(walked).select("learner_id", rounded(F.col("values")[0]).alias("theta"))


@query("run_trace", _IRT + """
, e AS (SELECT learner_id, solving_id, avg(correct - p) AS e_group, min(seq) AS run_start, max(seq) AS run_end FROM pred GROUP BY ALL)
SELECT pred.interaction_id, run_start, run_end, """ + number("e_group") + " AS e_group, " + number("theta + 0.05e0 * (e_group - 1e-4 * theta)") + """ AS theta_post
FROM pred JOIN e USING (learner_id, solving_id)""")
def run_trace(spark, d):
    k = Kt1(spark, d)
    rows = k.contiguous
    trace = R.trace_of(R.replay(with_difficulty(rows, k), AbilityModel(), hot=k.hot))
    full = R.run_trace(trace, W.runs(rows, hot=k.hot), 0.05, 1e-4)
    return full.select("interaction_id", "run_start", "run_end", rounded("e_group").alias("e_group"), rounded("theta_post").alias("theta_post"))


_ZERO = "list_transform(range(101), lambda z: 0.0e0)"
_COUNT_KC = "len(list_filter(runs.toks, lambda t: t = q))"
_TOKEN = _RUNS + f"""
, kcount AS (SELECT learner_id, rn, items, list_transform(range(101), lambda q: {_COUNT_KC}) AS kc FROM runs),
rec AS (
  SELECT DISTINCT learner_id, CAST(0 AS BIGINT) AS rn, 0.0e0 AS theta, {_ZERO} AS r FROM runs
  UNION ALL
  SELECT learner_id, rn + 1, theta + 0.05e0 * (e - 1e-4 * theta),
         list_transform(range(101), lambda q: CASE WHEN kc[q + 1] > 0 THEN 0.8e0 * r[q + 1] + 0.2e0 * e / kc[q + 1] ELSE r[q + 1] END)
  FROM (SELECT rec.*, k.kc, list_avg(list_transform(k.items, lambda x: {_ERR})) AS e
        FROM rec JOIN kcount k ON k.learner_id = rec.learner_id AND k.rn = rec.rn) step),
pred AS (
  SELECT interaction_id, rec.theta - b AS z,
         CASE WHEN len(kc_ids) = 0 THEN 0.0e0 ELSE list_avg(list_transform(kc_ids, lambda c: rec.r[c + 1])) END AS r_bar
  FROM rr JOIN runs USING (learner_id, solving_id) JOIN rec ON rec.learner_id = runs.learner_id AND rec.rn = runs.rn)
SELECT interaction_id, {number(SIGMOID.format("z"))} AS p_global, {number("r_bar")} AS r_bar, {number(SIGMOID.format("z + r_bar"))} AS probability FROM pred
"""
_SKILL = _RUNS + f"""
, rec AS (
  SELECT DISTINCT learner_id, CAST(0 AS BIGINT) AS rn, 0.0e0 AS theta, list_transform(range(7), lambda z: 0.0e0) AS r FROM runs
  UNION ALL
  SELECT learner_id, rn + 1, theta + 0.05e0 * (list_avg(list_transform(err, lambda x: x.e)) - 1e-4 * theta),
         list_transform(range(7), lambda q: CASE WHEN len(list_filter(err, lambda x: x.k = q)) > 0
           THEN 0.8e0 * r[q + 1] + 0.2e0 * list_avg(list_transform(list_filter(err, lambda x: x.k = q), lambda x: x.e)) ELSE r[q + 1] END)
  FROM (SELECT rec.*, list_transform(runs.items, lambda x: struct_pack(k := x.k, e := {_ERR})) AS err
        FROM rec JOIN runs ON runs.learner_id = rec.learner_id AND runs.rn = rec.rn) step),
pred AS (
  SELECT interaction_id, rec.theta - b AS z, rec.r[one_kc + 1] AS r_bar
  FROM rr JOIN runs USING (learner_id, solving_id) JOIN rec ON rec.learner_id = runs.learner_id AND rec.rn = runs.rn)
SELECT interaction_id, {number(SIGMOID.format("z"))} AS p_global, {number("r_bar")} AS r_bar, {number(SIGMOID.format("z + r_bar"))} AS probability FROM pred
"""


def _residual_columns(trace: DataFrame) -> DataFrame:
    return trace.select("interaction_id", *[rounded(c).alias(c) for c in ("p_global", "r_bar", "probability")])


@query("arkt_eval_token", _TOKEN)
def arkt_eval_token(spark, d):
    k = Kt1(spark, d)
    rows = with_difficulty(k.contiguous, k).withColumn("tag_idxs", F.col("kc_ids"))
    return _residual_columns(R.trace_of(R.replay(rows, ResidualModel(), hot=k.hot)))


@query("arkt_eval_skill", _SKILL)
def arkt_eval_skill(spark, d):
    k = Kt1(spark, d)
    rows = with_difficulty(k.contiguous, k).withColumn("tag_idxs", F.array(F.pmod(item_number(), F.lit(7))))
    return _residual_columns(R.trace_of(R.replay(rows, ResidualModel(rule="skill_mean"), hot=k.hot)))


@query("headline_and_global", _TOKEN.replace("SELECT interaction_id, round", "SELECT interaction_id, round", 1).rsplit("SELECT interaction_id", 1)[0] + f"""
, two AS (SELECT 'headline' AS score, correct, {SIGMOID.format("z + r_bar")} AS p FROM pred JOIN contig USING (interaction_id)
          UNION ALL SELECT 'global', correct, {SIGMOID.format("z")} FROM pred JOIN contig USING (interaction_id))""" + _AUC.format(g="score", src="two") + f"SELECT g AS score, {_AUC_OUT} FROM m")
def headline_and_global(spark, d):
    k = Kt1(spark, d)
    rows = with_difficulty(k.contiguous, k).withColumn("tag_idxs", F.col("kc_ids"))
    trace = R.trace_of(R.replay(rows, ResidualModel(), keep=("interaction_id", "correct", "metric_mask"), hot=k.hot))
    return metric_columns(M.headline_and_global(trace), "score")


@query("phase_chain", _IRT + """
SELECT interaction_id, """ + number("p") + " AS probability FROM pred JOIN (SELECT interaction_id, split FROM splitrows) USING (interaction_id) WHERE split = 'valid'")
def phase_chain(spark, d):
    """TRAIN states carried into VALID; bundles never straddle, so the pass is uninterrupted."""
    k = Kt1(spark, d)
    rows = with_difficulty(k.prepared, k)
    fitted = R.states_of(R.replay(rows.where(F.col("split") == "train"), AbilityModel(), hot=k.hot))
    valid = R.trace_of(R.replay(rows.where(F.col("split") == "valid"), AbilityModel(), fitted, hot=k.hot))
    return valid.select("interaction_id", rounded("probability").alias("probability"))


_TEST = KT1 + f"""
, cohort AS (SELECT *, seq % 10 <> 3 AS mask FROM splitrows WHERE user_no % 11 <> 5),
vocab AS (SELECT DISTINCT item_id, item_no FROM splitrows WHERE split <> 'test' AND item_no % 13 <> 3),
rr AS (SELECT interaction_id, learner_id, solving_id, split, correct, mask AND v.item_id IS NOT NULL AS mask,
              (coalesce(v.item_no, (SELECT arg_min(item_no, item_id) FROM vocab)) * 7 % 11 - 5) / 10.0e0 AS b
       FROM cohort LEFT JOIN vocab v USING (item_id) WHERE split = 'test' OR (mask AND v.item_id IS NOT NULL)),
runs AS (SELECT learner_id, dense_rank() OVER (PARTITION BY learner_id ORDER BY solving_id) - 1 AS rn, solving_id,
         list(struct_pack(y := correct, b := b)) AS items FROM rr GROUP BY learner_id, solving_id),
rec AS (
  SELECT DISTINCT learner_id, CAST(0 AS BIGINT) AS rn, 0.0e0 AS theta FROM runs
  UNION ALL
  SELECT rec.learner_id, rec.rn + 1, rec.theta + 0.05e0 * (list_avg(list_transform(runs.items, lambda x: {_ERR})) - 1e-4 * rec.theta)
  FROM rec JOIN runs ON runs.learner_id = rec.learner_id AND runs.rn = rec.rn)
SELECT interaction_id, mask AS metric_mask, {number("theta")} AS theta_pre, {number(SIGMOID.format("theta - b"))} AS probability
FROM rr JOIN runs USING (learner_id, solving_id) JOIN rec ON rec.learner_id = runs.learner_id AND rec.rn = runs.rn WHERE split = 'test'
"""


@query("test_eval", _TEST)
def test_eval(spark, d):
    """TRAIN, VALID and TEST in a row, with masked rows, items outside the vocabulary and learners outside the cohort."""
    k = Kt1(spark, d)
    rows = k.prepared.withColumn("metric_mask", F.col("seq") % 10 != 3)
    fitted = V.fitted_rows(rows)
    learners = V.vocabulary(rows.where(F.substring("learner_id", 2, 20).cast("long") % 11 != 5), F.col("learner_id"))
    items = V.vocabulary(fitted.where(item_number() % 13 != 3), F.col("item_id"))
    learners, items = cut_lineage(learners), cut_lineage(items)
    difficulty = with_difficulty(items.select(F.col("id").alias("item_id")), k)
    states = None
    for phase in ("train", "valid", "test"):
        part = R.phase_input(rows, phase, learners, items, difficulty)
        walked = cut_lineage(R.replay(part, AbilityModel(), states, keep=("interaction_id", "metric_mask"), hot=k.hot))
        moved = R.states_of(walked)
        if states is not None:
            moved = moved.unionByName(states.join(moved.select("learner_id").distinct(), "learner_id", "left_anti"))
        states = moved
    return R.trace_of(walked).select("interaction_id", "metric_mask", rounded("theta_pre").alias("theta_pre"), rounded("probability").alias("probability"))


@query("user_model", KT1 + """
SELECT interaction_id, """ + number("1.0e0 / (1 + min(ord) OVER (PARTITION BY learner_id, bundle_id))") + " AS probability FROM canon")
def user_model(spark, d):
    k = Kt1(spark, d)
    model = CountModel()
    check_model(model)
    trace = R.trace_of(R.replay(k.contiguous, model, hot=k.hot))
    return trace.select("interaction_id", rounded("probability").alias("probability"))


# One step a run over the whole log: difficulties of all items move along, ability and residuals start anew with each learner.
_TRAIN = KT1 + f"""
, ix AS MATERIALIZED (SELECT item_id, row_number() OVER (ORDER BY item_no) AS i FROM (SELECT DISTINCT item_id, item_no FROM contig)),
runs AS (SELECT learner_id, row_number() OVER (ORDER BY min(seq)) - 1 AS g, min(seq) AS first_seq, max(seq) AS last_seq,
         list(struct_pack(y := correct, i := i) ORDER BY seq) AS items, flatten(list(kc_ids)) AS toks
         FROM contig JOIN ix USING (item_id) GROUP BY learner_id, solving_id),
kcount AS MATERIALIZED (SELECT *, list_transform(range(101), lambda q: {_COUNT_KC}) AS kc FROM runs),
rec AS (
  SELECT CAST(-1 AS BIGINT) AS g, '' AS learner_id, 0.0e0 AS theta_pre, 0.0e0 AS theta, list_transform(range((SELECT count(*) FROM ix)), lambda z: 0.0e0) AS b_pre,
         list_transform(range((SELECT count(*) FROM ix)), lambda z: 0.0e0) AS b, {_ZERO} AS r_pre, {_ZERO} AS r
  UNION ALL
  SELECT g, learner_id, t, t + 0.05e0 * (list_avg(list_transform(err, lambda x: x.e)) - 1e-4 * t), b,
         list_transform(b, lambda v, i: CASE WHEN list_contains(list_transform(err, lambda x: x.i), i)
           THEN v + 0.02e0 * (-(list_filter(err, lambda x: x.i = i)[-1].e) - 1e-4 * v) ELSE v END), r,
         list_transform(range(101), lambda q: CASE WHEN kc[q + 1] > 0
           THEN 0.8e0 * r[q + 1] + 0.2e0 * list_avg(list_transform(err, lambda x: x.e)) / kc[q + 1] ELSE r[q + 1] END)
  FROM (SELECT s.*, list_transform(items, lambda x: struct_pack(i := x.i, e := x.y - {SIGMOID.format("t - b[x.i]")})) AS err
        FROM (SELECT k.*, rec.b, CASE WHEN k.learner_id = rec.learner_id THEN rec.theta ELSE 0.0e0 END AS t,
                     CASE WHEN k.learner_id = rec.learner_id THEN rec.r ELSE {_ZERO} END AS r
              FROM rec JOIN kcount k ON k.g = rec.g + 1) s) step)
"""


@query("irt_train", _TRAIN + "SELECT item_id, " + number("b[i]") + " AS b FROM ix, (SELECT b FROM rec ORDER BY g DESC LIMIT 1)")
def irt_train(spark, d):
    k = Kt1(spark, d)
    fit = train(k.contiguous, learner_hot=k.hot)
    return fit.difficulty.select("item_id", rounded("b").alias("b"))


@query("arkt_train", _TRAIN + f"""
, pred AS (
  SELECT interaction_id, theta_pre - b_pre[i] AS z,
         CASE WHEN len(kc_ids) = 0 THEN 0.0e0 ELSE list_avg(list_transform(kc_ids, lambda c: r_pre[c + 1])) END AS r_bar
  FROM contig JOIN ix USING (item_id) JOIN runs ON runs.learner_id = contig.learner_id AND contig.seq BETWEEN first_seq AND last_seq JOIN rec ON rec.g = runs.g)
SELECT interaction_id, {number(SIGMOID.format("z"))} AS p_global, {number("r_bar")} AS r_bar, {number(SIGMOID.format("z + r_bar"))} AS probability FROM pred""")
def arkt_train(spark, d):
    k = Kt1(spark, d)
    rows = k.contiguous.withColumn("tag_idxs", F.col("kc_ids"))
    fit = train(rows, residual=ResidualModel(), learner_hot=k.hot)
    return _residual_columns(R.trace_of(fit.walked))


@query("misaligned_predictions", KT1 + """
, r AS (SELECT seq, interaction_id FROM contig),
p AS (SELECT CASE WHEN seq % 1009 = 2 THEN seq + 1 ELSE seq END AS seq, CASE WHEN seq % 1009 = 1 THEN 'x' || interaction_id ELSE interaction_id END AS interaction_id
      FROM contig WHERE seq % 1009 <> 0)
SELECT coalesce(r.interaction_id, p.interaction_id) AS interaction_id,
       CASE WHEN p.interaction_id IS NULL THEN 'missing' WHEN r.interaction_id IS NULL THEN 'extra' ELSE 'reordered' END AS problem
FROM r FULL JOIN p USING (interaction_id) WHERE r.seq IS DISTINCT FROM p.seq""")
def misaligned_predictions(spark, d):
    rows = Kt1(spark, d).contiguous.select("seq", "interaction_id")
    m = F.col("seq") % 1009
    output = rows.where(m != 0).select(
        F.when(m == 2, F.col("seq") + 1).otherwise(F.col("seq")).alias("seq"),
        F.when(m == 1, F.concat(F.lit("x"), "interaction_id")).otherwise(F.col("interaction_id")).alias("interaction_id"))
    return align.misaligned(rows, output)


@query("aligned_predictions", KT1 + _COUNT + "SELECT interaction_id, correct, " + number("p") + " AS probability FROM scored")
def aligned_predictions(spark, d):
    scored = scored_rows(spark, d)
    out = align.aligned(Kt1(spark, d).canonical.select("interaction_id", "correct"), scored)
    return out.select("interaction_id", "correct", rounded("probability").alias("probability"))


@query("prediction_trace_hash")
def prediction_trace_hash(spark, d):
    scored = scored_rows(spark, d)
    return I.tree_hash(scored, I.trace_line(), "split")


@query("metric_evidence")
def metric_evidence(spark, d):
    return I.metric_evidence(M.masked_metrics(scored_rows(spark, d)))


# --- sequence models -----------------------------------------------------------------------


def encoded_sequence(k: Kt1) -> tuple[DataFrame, int, int]:
    """Contiguous rows with dense item and KC indexes, and the two vocabulary sizes."""
    rows = cut_lineage(k.contiguous)
    items = cut_lineage(V.vocabulary(rows, F.col("item_id")))
    kcs = cut_lineage(V.kc_vocabulary(rows))
    coded = V.encode_kcs(V.encode(rows, items, "item_id", "problem_idx"), kcs)
    return coded, items.count(), kcs.count()


def recurrent_weights(n_items: int, n_kcs: int, seed: int = 11, size: int = 8, kc: bool = False) -> dict:
    g = np.random.default_rng(seed)
    draw = lambda *shape: g.normal(0, 0.3, shape)
    w = dict(interaction_emb=draw(2 * n_items, size), w_ih=draw(4 * size, size), w_hh=draw(4 * size, size),
             b_ih=draw(4 * size), b_hh=draw(4 * size), out_w=draw(n_items, size), out_b=draw(n_items))
    return {**w, "kc_emb": draw(2 * n_kcs, size)} if kc else w


def memory_weights(n_items: int, n_kcs: int, seed: int = 13, size: int = 8, slots: int = 5, kc: bool = False) -> dict:
    g = np.random.default_rng(seed)
    draw = lambda *shape: g.normal(0, 0.3, shape)
    w = dict(key_emb=draw(n_items, size), slots=draw(slots, size), memory0=draw(slots, size), value_emb=draw(2 * n_items, size),
             erase_w=draw(size, size), erase_b=draw(size), add_w=draw(size, size), add_b=draw(size),
             mix_w=draw(size, 2 * size), mix_b=draw(size), out_w=draw(size), out_b=draw(1))
    return {**w, "kc_emb": draw(n_kcs, size)} if kc else w


def _sequence_query(make, kind, kc):
    def run(spark, d):
        k = Kt1(spark, d)
        rows, n_items, n_kcs = encoded_sequence(k)
        trace = R.trace_of(R.replay(rows, kind(make(n_items, n_kcs, kc=kc)), hot=k.hot, tolerance=1e-14))
        return trace.select("interaction_id", rounded("probability").alias("probability"))

    return run


query("dkt_replay")(_sequence_query(recurrent_weights, RecurrentModel, False))
query("dkt_qc_replay")(_sequence_query(recurrent_weights, RecurrentModel, True))
query("dkvmn_replay")(_sequence_query(memory_weights, MemoryModel, False))
query("dkvmn_qc_replay")(_sequence_query(memory_weights, MemoryModel, True))


_CHUNKS = KT1 + """
, sp AS (SELECT learner_id, dense_rank() OVER (PARTITION BY learner_id ORDER BY solving_id) - 1 AS run, count(*) AS n FROM contig GROUP BY learner_id, solving_id),
ch AS (SELECT learner_id, run, n, CAST(0 AS BIGINT) AS chunk, n AS filled FROM sp WHERE run = 0
  UNION ALL SELECT sp.learner_id, sp.run, sp.n, ch.chunk + CASE WHEN ch.filled + sp.n > 10 THEN 1 ELSE 0 END,
    CASE WHEN ch.filled + sp.n > 10 THEN sp.n ELSE ch.filled + sp.n END FROM ch JOIN sp ON sp.learner_id = ch.learner_id AND sp.run = ch.run + 1)
"""


@query("tbptt_chunks", _CHUNKS + "SELECT learner_id, run, n AS run_rows, chunk FROM ch")
def tbptt_chunks(spark, d):
    k = Kt1(spark, d)
    return sequence.tbptt_chunks(W.run_spans(W.runs(k.contiguous, hot=k.hot)), 10, k.hot)


@query("learner_slabs", _CHUNKS + """
, lr AS (SELECT learner_id, row_number() OVER (ORDER BY learner_id) - 1 AS learner_rank FROM (SELECT DISTINCT learner_id FROM ch))
SELECT learner_id, run, chunk, learner_rank // 16 AS pool FROM ch JOIN lr USING (learner_id)""")
def learner_slabs(spark, d):
    k = Kt1(spark, d)
    chunks = sequence.tbptt_chunks(W.run_spans(W.runs(k.contiguous, hot=k.hot)), 10, k.hot)
    return sequence.learner_slabs(chunks, 16).select("learner_id", "run", "chunk", "pool")


def _second(rows: str, key: str, order: str) -> str:
    """First run of each segment at which some key occurs for the second time."""
    return f"""SELECT segment, min(run) AS pos FROM (SELECT segment, run, row_number() OVER (PARTITION BY segment{key} ORDER BY {order}) AS k
      FROM {rows}) WHERE k = 2 GROUP BY segment"""


@query("parity_window", KT1 + f"""
, st AS (SELECT *, lag(learner_id || chr(1) || bundle_id) OVER (ORDER BY seq) IS DISTINCT FROM learner_id || chr(1) || bundle_id AS fresh FROM dense),
rn AS (SELECT *, max(CASE WHEN fresh THEN seq END) OVER (ORDER BY seq) AS run FROM st),
per AS (SELECT run, min(learner_id) AS learner_id, min(bundle_id) AS bundle_id, count(*) AS n, bool_or(seq % 997 = 996) AS barrier, bool_or(correct = 0) AS has0,
        bool_or(correct = 1) AS has1, bool_or(len(kc_ids) >= 2) AS multi, bool_or(len(kc_ids) <> len(list_distinct(kc_ids))) AS rep FROM rn GROUP BY run),
sg AS (SELECT *, count_if(barrier) OVER (ORDER BY run) AS segment FROM per),
cl AS (SELECT * FROM sg WHERE NOT barrier),
ro AS (SELECT rn.seq, rn.run, rn.item_id, rn.kc_ids, cl.segment FROM rn JOIN cl USING (run)),
co AS (SELECT DISTINCT segment, run, unnest(kc_ids) AS kc FROM ro),
le AS (SELECT segment, learner_id, min(run) AS run FROM cl GROUP BY ALL),
hits AS (
  SELECT segment, min(run) AS pos FROM cl WHERE n = 1 GROUP BY segment UNION ALL SELECT segment, min(run) FROM cl WHERE n > 1 GROUP BY segment
  UNION ALL SELECT segment, min(run) FROM cl WHERE has0 GROUP BY segment UNION ALL SELECT segment, min(run) FROM cl WHERE has1 GROUP BY segment
  UNION ALL SELECT segment, min(run) FROM cl WHERE multi GROUP BY segment UNION ALL SELECT segment, min(run) FROM cl WHERE rep GROUP BY segment
  UNION ALL {_second("cl", ", learner_id, bundle_id", "run")} UNION ALL {_second("ro", ", item_id", "seq")}
  UNION ALL {_second("co", ", kc", "run")} UNION ALL {_second("le", "", "run")}),
ready AS (SELECT segment, max(pos) AS pos FROM hits GROUP BY segment HAVING count(*) = 10)
SELECT (SELECT min(run) FROM cl WHERE cl.segment = ready.segment) AS start, pos + n AS "end" FROM ready JOIN cl ON cl.segment = ready.segment AND cl.run = pos
ORDER BY start LIMIT 1""")
def parity_window(spark, d):
    """Window over the interleaved source order; every 997th row is a sentinel."""
    k = Kt1(spark, d)
    rows = W.runs(k.dense, physical=True, hot=k.hot)
    marked = rows.withColumn("tags", F.col("kc_ids")).withColumn("sentinel", (F.col("seq") % 997 == 996))
    return sequence.parity_window(marked)


@query("tutor_arkt_eval")
def tutor_arkt_eval(spark, d):
    """TRAIN-then-VALID skill-mean replay of the tutor log with fixed difficulties."""
    t = Tutor(spark, d)
    rows = V.fitted_rows(t.encoded).select(
        "seq", "learner_id", F.concat_ws("|", "student_id", "timestamp").alias("bundle_id"), "correct", "timestamp",
        ((F.pmod(F.col("problem_idx") * 7, F.lit(11)) - 5) / 10.0).alias("b"), F.array("skill_idx").alias("tag_idxs"), "split")
    trace = R.trace_of(R.replay(rows, ResidualModel(rule="skill_mean"), keep=("split",)))
    return trace.where(F.col("split") == "valid").select("seq", rounded("probability").alias("probability"))


@query("fitted_model_eval", KT1 + f"""
, rate AS (SELECT item_id, ln((count(*) - sum(correct) + 1.0e0) / (sum(correct) + 1.0e0)) AS b FROM splitrows WHERE split = 'train' GROUP BY item_id),
rr AS (SELECT s.*, coalesce(rate.b, 0.0e0) AS b FROM splitrows s LEFT JOIN rate USING (item_id) WHERE split <> 'train'),
runs AS (SELECT learner_id, solving_id, dense_rank() OVER (PARTITION BY learner_id ORDER BY solving_id) - 1 AS rn,
         list(struct_pack(y := correct, b := b)) AS items FROM rr GROUP BY learner_id, solving_id),
rec AS (
  SELECT DISTINCT learner_id, CAST(0 AS BIGINT) AS rn, 0.0e0 AS theta FROM runs
  UNION ALL
  SELECT rec.learner_id, rec.rn + 1, rec.theta + 0.05e0 * (list_avg(list_transform(runs.items, lambda x: {_ERR})) - 1e-4 * rec.theta)
  FROM rec JOIN runs ON runs.learner_id = rec.learner_id AND runs.rn = rec.rn)
SELECT interaction_id, split, {number(SIGMOID.format("theta - b"))} AS probability
FROM rr JOIN runs USING (learner_id, solving_id) JOIN rec ON rec.learner_id = runs.learner_id AND rec.rn = runs.rn""")
def fitted_model_eval(spark, d):
    """Item-rate model: trained, stored, restored for VALID and again for TEST, which continues from VALID."""
    rows = Kt1(spark, d).prepared.withColumn("metric_mask", F.lit(True))
    roles, path = [("train", "train"), ("valid", "valid"), ("test", "test")], scratch_path(spark, "checkpoint")
    valid = workflows.run_fitted_model(rows, ItemRateModel, roles[:2], path)
    test = workflows.evaluate_fitted_model(rows, ItemRateModel, roles, path, valid.trace_hash)
    both = valid.predictions.unionByName(test.predictions)
    return both.select("interaction_id", "split", rounded("probability").alias("probability"))
