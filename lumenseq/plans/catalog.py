"""Registered queries: one callable and, where SQL can express it, one oracle per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseq.functions import scalars as S
from lumenseq.operators import cleaning as C
from lumenseq.operators import diagnose as D
from lumenseq.operators import identity as I
from lumenseq.operators import metrics as M
from lumenseq.operators import replay as R
from lumenseq.operators import sampling as A
from lumenseq.operators import splits as P
from lumenseq.operators import validate as L
from lumenseq.operators import vocab as V
from lumenseq.operators import windows as W
from lumenseq.plans.oracle import DAMAGED, KT1, TUTOR, issue, number
from lumenseq.plans.tables import Kt1, Tutor, table
from lumenseq.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(column: Column | str, digits: int = 7) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits) + F.lit(0.0)


def text(array: str) -> Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ",")


def as_long(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if c in names else F.col(c) for c in df.columns])


# --- raw logs to canonical rows ------------------------------------------------------------


@query("canonical_events", KT1 + """
SELECT seq, interaction_id, learner_id, item_id, correct, array_to_string(kc_ids, ',') AS kc_ids, ord AS "order",
       ts_ms AS "timestamp", bundle_id, source_row, solving_id FROM canon""")
def canonical_events(spark, d):
    return Kt1(spark, d).canonical.select(
        "seq", "interaction_id", "learner_id", "item_id", "correct", text("kc_ids").alias("kc_ids"), "order",
        "timestamp", "bundle_id", "source_row", "solving_id")


@query("drop_reason_stats", KT1 + """
SELECT drop_reason AS reason, count(*) AS "rows", CAST(list_position(['user_answer_minus_one', 'user_answer_empty', 'user_answer_unexpected', 'missing_metadata'], drop_reason) AS BIGINT) AS position
FROM marked WHERE drop_reason IS NOT NULL GROUP BY drop_reason""")
def drop_reason_stats(spark, d):
    return as_long(C.reason_counts(Kt1(spark, d).marked, C.KT1_REASONS), "position")


@query("drop_reasons_damaged", KT1 + """,
bad AS (
  SELECT CASE WHEN seq % 23 = 0 THEN '' ELSE learner_id END AS learner_id, CASE WHEN seq % 23 = 1 THEN '' ELSE item_id END AS item_id,
         CASE WHEN seq % 23 = 2 THEN 'x' ELSE CAST(solving_id AS VARCHAR) END AS solving, CASE WHEN seq % 23 = 3 THEN '1.5' ELSE CAST(ts_ms AS VARCHAR) END AS ts,
         CASE seq % 23 WHEN 4 THEN '-1' WHEN 5 THEN 'e' ELSE user_answer END AS answer
  FROM ev),
named AS (
  SELECT CASE WHEN bad.learner_id = '' THEN 'empty_user_id' WHEN bad.item_id = '' THEN 'empty_question_id'
              WHEN solving = 'x' THEN 'missing_solving_id' WHEN ts = '1.5' THEN 'invalid_timestamp'
              WHEN answer = '-1' THEN 'user_answer_minus_one' WHEN answer = '' THEN 'user_answer_empty' WHEN answer = 'e' THEN 'user_answer_unexpected'
              WHEN cat.item_id IS NULL THEN 'missing_metadata' WHEN cat.item_no % 10 = 8 THEN 'missing_correct_answer' END AS reason
  FROM bad LEFT JOIN cat USING (item_id))
SELECT reason, count(*) AS "rows", CAST(list_position(['user_answer_minus_one', 'user_answer_empty', 'user_answer_unexpected', 'missing_metadata',
       'missing_solving_id', 'empty_question_id', 'empty_user_id', 'invalid_timestamp', 'missing_correct_answer'], reason) AS BIGINT) AS position
FROM named WHERE reason IS NOT NULL GROUP BY reason""")
def drop_reasons_damaged(spark, d):
    """All nine reasons: every rule is broken by some rows of a damaged log or catalog."""
    k = Kt1(spark, d)
    spoil = lambda c, n, v: F.when(F.col("seq") % 23 == n, v).otherwise(F.col(c))
    raw = k.raw.withColumns({
        "user_id": spoil("user_id", 0, ""), "question_id": spoil("question_id", 1, ""), "solving_id": spoil("solving_id", 2, "x"),
        "timestamp": spoil("timestamp", 3, "1.5"), "user_answer": F.when(F.col("seq") % 23 == 5, "e").otherwise(spoil("user_answer", 4, "-1"))})
    items = k.questions.withColumn("correct_answer", F.when(F.substring("question_id", -1, 1) == "8", "").otherwise(F.col("correct_answer")))
    return as_long(C.reason_counts(C.kt1_drop_reason(raw, C.question_catalog(items)), C.KT1_REASONS), "position")


@query("filter_stats", KT1 + """
SELECT count(*) AS raw_rows, count(*) FILTER (drop_reason IS NULL) AS eligible_rows,
       count(*) FILTER (drop_reason LIKE 'user_answer%') AS dropped_invalid_user_answer,
       count(*) FILTER (drop_reason = 'missing_metadata') AS dropped_missing_metadata FROM marked""")
def filter_stats(spark, d):
    return C.filter_stats(Kt1(spark, d).marked)


@query("parse_tags", KT1 + "SELECT item_id AS question_id, array_to_string(kc_ids, ',') AS kc_ids, correct_answer FROM cat")
def parse_tags(spark, d):
    return Kt1(spark, d).catalog.select("question_id", text("kc_ids").alias("kc_ids"), "correct_answer")


@query("canonical_orders", TUTOR + """
SELECT seq, 'assist17:' || seq AS interaction_id, CAST(student_id AS VARCHAR) AS learner_id, CAST(problem_id AS VARCHAR) AS item_id,
       correct, coalesce(CAST(skill_idx AS VARCHAR), '') AS kc_ids, CAST(ts AS DOUBLE) AS "timestamp",
       student_id || '|' || ts AS bundle_id, split, CAST(metric_mask AS BIGINT) AS metric_mask, source_row FROM enc""")
def canonical_orders(spark, d):
    c = Tutor(spark, d).canonical
    return c.select("seq", "interaction_id", "learner_id", "item_id", "correct", text("kc_ids").alias("kc_ids"), "timestamp",
                    "bundle_id", "split", F.col("metric_mask").cast("long").alias("metric_mask"), "source_row")


@query("tutor_drop_reasons", TUTOR + """
, r AS (SELECT CASE WHEN attempt <> 1 THEN 'non_first_attempt' WHEN skill_id = '' THEN 'missing_kc' END AS reason FROM tr)
SELECT reason, count(*) AS "rows" FROM r WHERE reason IS NOT NULL GROUP BY reason""")
def tutor_drop_reasons(spark, d):
    return C.reason_counts(Tutor(spark, d).marked, C.TUTOR_REASONS).select("reason", "rows")


@query("global_order", TUTOR + "SELECT seq, student_id, ts AS \"timestamp\", source_row FROM te")
def global_order(spark, d):
    return Tutor(spark, d).ordered.select("seq", "student_id", "timestamp", "source_row")


@query("bundle_or_interaction", """
SELECT event_id, CASE WHEN trim(b) = '' THEN 'i' || event_id ELSE trim(b) END AS bundle_id
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '  ' WHEN event_id % 3 = 1 THEN NULL ELSE ' b' || user_id || ' ' END AS b FROM events)
WHERE b IS NOT NULL OR TRUE""".replace("trim(b) = ''", "coalesce(trim(b), '') = ''"))
def bundle_or_interaction(spark, d):
    e = table(spark, d, "events")
    b = F.when(F.col("event_id") % 3 == 0, "  ").when(F.col("event_id") % 3 == 2, F.concat(F.lit(" b"), F.col("user_id").cast("string"), F.lit(" ")))
    i = F.concat(F.lit("i"), F.col("event_id").cast("string"))
    return e.select("event_id", S.bundle_or_interaction(b, i).alias("bundle_id"))


# --- windows -------------------------------------------------------------------------------


@query("learner_order", KT1 + 'SELECT interaction_id, ord AS "order" FROM canon')
def learner_order(spark, d):
    return Kt1(spark, d).canonical.select("interaction_id", "order")


@query("previous_values", KT1 + """
SELECT interaction_id, last_value(CASE WHEN seq % 5 <> 0 THEN ts_ms END IGNORE NULLS) OVER w AS prev_ts,
       last_value(solving_id) OVER w AS prev_solving
FROM canon WINDOW w AS (PARTITION BY learner_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def previous_values(spark, d):
    k = Kt1(spark, d)
    sparse = F.when(F.col("seq") % 5 != 0, F.col("timestamp"))
    return W.with_previous(k.canonical, {"prev_ts": sparse, "prev_solving": F.col("solving_id")}, k.hot).select(
        "interaction_id", "prev_ts", "prev_solving")


_RUNS = """
, s AS (SELECT *, CASE WHEN lag(bundle_id) OVER w IS DISTINCT FROM bundle_id {physical} THEN 1 ELSE 0 END AS st,
               row_number() OVER w - 1 AS i FROM {src} WINDOW w AS (PARTITION BY learner_id ORDER BY seq)),
t AS (SELECT *, sum(st) OVER (PARTITION BY learner_id ORDER BY seq) - 1 AS run FROM s)
SELECT seq, learner_id, CAST(run AS BIGINT) AS run, CAST(min(i) OVER (PARTITION BY learner_id, run) AS BIGINT) AS revealed,
       min(seq) OVER (PARTITION BY learner_id, run) AS run_first_seq FROM t"""


@query("runs_learner", KT1 + _RUNS.format(physical="", src="dense"))
def runs_learner(spark, d):
    k = Kt1(spark, d)
    return W.runs(k.dense, hot=k.hot).select("seq", "learner_id", "run", "revealed", "run_first_seq")


@query("runs_physical", KT1 + _RUNS.format(physical="OR lag(seq) OVER w IS DISTINCT FROM seq - 1", src="dense"))
def runs_physical(spark, d):
    k = Kt1(spark, d)
    return W.runs(k.dense, physical=True, hot=k.hot).select("seq", "learner_id", "run", "revealed", "run_first_seq")


@query("run_spans", KT1 + """
SELECT learner_id, dense_rank() OVER (PARTITION BY learner_id ORDER BY min(seq)) - 1 AS run, min(seq) AS run_first,
       max(seq) AS run_last, count(*) AS run_rows FROM contig GROUP BY learner_id, solving_id""")
def run_spans(spark, d):
    k = Kt1(spark, d)
    return W.run_spans(W.runs(k.contiguous, hot=k.hot))


@query("bundle_revisits", KT1 + """
, s AS (SELECT *, lag(item_id) OVER (PARTITION BY learner_id ORDER BY seq) AS p FROM canon),
st AS (SELECT * FROM s WHERE p IS DISTINCT FROM item_id)
SELECT interaction_id, item_id FROM st QUALIFY row_number() OVER (PARTITION BY learner_id, item_id ORDER BY seq) > 1""")
def bundle_revisits(spark, d):
    k = Kt1(spark, d)
    return W.revisits(k.canonical, "item_id", k.hot).select("interaction_id", "item_id")


@query("bundle_ranks", KT1 + """
SELECT learner_id, bundle_id, min(seq) AS first_seq, count(*) AS bundle_rows,
       row_number() OVER (PARTITION BY learner_id ORDER BY min(seq)) - 1 AS bundle_rank,
       count(*) OVER (PARTITION BY learner_id) AS n_bundles FROM canon GROUP BY learner_id, bundle_id""")
def bundle_ranks(spark, d):
    k = Kt1(spark, d)
    return W.bundle_table(k.canonical, "first_seq", k.hot)


@query("later_duplicates", KT1 + """
SELECT interaction_id FROM canon QUALIFY row_number() OVER (PARTITION BY learner_id, item_id ORDER BY seq) > 1""")
def later_duplicates(spark, d):
    return W.later_duplicates(Kt1(spark, d).canonical, ["learner_id", "item_id"]).select("interaction_id")


@query("bundle_pre_state", KT1 + """
SELECT interaction_id, learner_id, bundle_id, ord AS "order",
       min(ord) OVER (PARTITION BY learner_id, bundle_id) AS pre_bundle_update_count FROM canon""")
def bundle_pre_state(spark, d):
    k = Kt1(spark, d)
    return R.bundle_pre_state(k.canonical, k.hot)


# --- splits --------------------------------------------------------------------------------


@query("split_fractional", KT1 + """
, b AS (SELECT learner_id, bundle_id, row_number() OVER (PARTITION BY learner_id ORDER BY min(seq)) - 1 AS rk,
               count(*) OVER (PARTITION BY learner_id) AS n FROM canon GROUP BY learner_id, bundle_id)
SELECT interaction_id, CASE WHEN rk < trunc(n * 0.6e0) THEN 'train'
       WHEN rk < trunc(n * 0.6e0) + least(trunc(n * 0.2e0), n - trunc(n * 0.6e0)) THEN 'valid' ELSE 'test' END AS split
FROM canon JOIN b USING (learner_id, bundle_id)""")
def split_fractional(spark, d):
    k = Kt1(spark, d)
    return P.fractional_bundle_split(k.canonical, 0.6, 0.2, k.hot).select("interaction_id", "split")


@query("split_solving", KT1 + "SELECT interaction_id, split FROM splitrows")
def split_solving(spark, d):
    return Kt1(spark, d).split.select("interaction_id", "split")


@query("split_temporal", TUTOR + "SELECT seq, nominal AS split FROM nom")
def split_temporal(spark, d):
    return Tutor(spark, d).nominal.select("seq", "split")


@query("split_closure", TUTOR + "SELECT seq, split, CAST(promoted AS BIGINT) AS promoted, CAST(crossing AS BIGINT) AS crossing FROM closed")
def split_closure(spark, d):
    return as_long(Tutor(spark, d).closed.select("seq", "split", "promoted", "crossing"), "promoted", "crossing")


@query("role_rows", KT1 + "SELECT interaction_id FROM splitrows WHERE split = 'valid'")
def role_rows(spark, d):
    roles = P.split_roles(["train", "valid", "test"], {"train": "train", "valid": "valid", "test": "test"})
    return P.role_rows(Kt1(spark, d).split, roles, "valid").select("interaction_id")


@query("outside_declared_splits", KT1 + "SELECT interaction_id, split FROM splitrows WHERE split <> 'train'")
def outside_declared_splits(spark, d):
    return P.outside_declared_splits(Kt1(spark, d).split, ["train"]).select("interaction_id", "split")


@query("split_counts", KT1 + 'SELECT split, count(*) AS "rows", count(DISTINCT learner_id) AS learners FROM splitrows GROUP BY split')
def split_counts(spark, d):
    return D.split_counts(Kt1(spark, d).split)


# --- vocabularies, joins and sets ----------------------------------------------------------


@query("vocab_items", TUTOR + "SELECT id, idx FROM vitem")
def vocab_items(spark, d):
    return Tutor(spark, d).items


@query("vocab_kcs", KT1 + """
SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx
FROM (SELECT DISTINCT unnest(kc_ids) AS id FROM splitrows WHERE split IN ('train', 'valid'))""")
def vocab_kcs(spark, d):
    return V.kc_vocabulary(V.fitted_rows(Kt1(spark, d).split))


@query("encode_rows", TUTOR + "SELECT seq, student_idx, problem_idx, skill_idx FROM enc")
def encode_rows(spark, d):
    return Tutor(spark, d).encoded.select("seq", "student_idx", "problem_idx", "skill_idx")


@query("encode_kcs", KT1 + """
, v AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT DISTINCT unnest(kc_ids) AS id FROM splitrows WHERE split = 'train')),
x AS (SELECT interaction_id, unnest(kc_ids) AS k, generate_subscripts(kc_ids, 1) AS pos FROM splitrows)
SELECT s.interaction_id, coalesce(string_agg(CAST(v.idx AS VARCHAR), ',' ORDER BY x.pos), '') AS tag_idxs
FROM splitrows s LEFT JOIN x USING (interaction_id) LEFT JOIN v ON v.id = x.k GROUP BY s.interaction_id""")
def encode_kcs(spark, d):
    rows = Kt1(spark, d).prepared
    vocab = V.kc_vocabulary(rows.where(F.col("split") == "train"))
    return V.encode_kcs(rows, vocab).select("interaction_id", text("tag_idxs").alias("tag_idxs"))


@query("group_ids", TUTOR + """
SELECT seq, dense_rank() OVER (ORDER BY student_id, ts) - 1 AS group_id FROM fitted""")
def group_ids(spark, d):
    rows = V.fitted_rows(Tutor(spark, d).closed)
    return V.group_ids(rows, ["student_id", "timestamp"]).select("seq", "group_id")


@query("group_ids_filled", TUTOR + """
, g AS (SELECT student_id, ts, dense_rank() OVER (ORDER BY student_id, ts) - 1 AS gid FROM (SELECT DISTINCT student_id, ts FROM fitted)),
h AS (SELECT c.seq, c.student_id, c.ts, CASE WHEN c.split <> 'test' THEN g.gid END AS gid FROM closed c LEFT JOIN g USING (student_id, ts)),
f AS (SELECT student_id, ts, row_number() OVER (ORDER BY min(seq)) + (SELECT max(gid) FROM h) AS fresh FROM h WHERE gid IS NULL GROUP BY student_id, ts)
SELECT h.seq, coalesce(h.gid, f.fresh) AS group_id FROM h LEFT JOIN f USING (student_id, ts)""")
def group_ids_filled(spark, d):
    key = ["student_id", "timestamp"]
    rows = Tutor(spark, d).closed.select("seq", *key, "split")
    # by the key alone, as the fresh ids are: rows are shuffled once
    named = rows.join(V.group_table(V.fitted_rows(rows), key), key, "left")
    named = named.withColumn("group_id", F.when(F.col("split").isin(*V.FITTED), F.col("group_id")))
    return V.fill_group_ids(named, key).select("seq", "group_id")


@query("oov_counts", TUTOR + """
SELECT count(*) AS oov_rows, count(DISTINCT problem_id) AS oov_types FROM enc WHERE split = 'test' AND problem_idx IS NULL""")
def oov_counts(spark, d):
    t = Tutor(spark, d)
    test = t.closed.where(F.col("split") == "test").withColumn("item_id", F.col("problem_id").cast("string"))
    return V.oov_counts(test, t.items)


def _policy(family: str) -> Callable:
    def run(spark, d):
        rows = Tutor(spark, d).encoded.withColumn("metric_mask", F.lit(True))
        out = V.apply_oov_policy(rows, family)
        return out.select("seq", "problem_idx", F.col("metric_mask").cast("long").alias("metric_mask"))

    return run


query("oov_policy_psychometric", TUTOR + """
SELECT seq, coalesce(problem_idx, 0) AS problem_idx, CAST(problem_idx IS NOT NULL AS BIGINT) AS metric_mask FROM enc""")(_policy("ar_kt"))
query("oov_policy_sequence", TUTOR + """
SELECT seq, problem_idx, CAST(1 AS BIGINT) AS metric_mask FROM enc WHERE problem_idx IS NOT NULL""")(_policy("dkt_q"))


@query("phase_rows", TUTOR + """
SELECT seq, coalesce(problem_idx, 0) AS problem_idx, CAST(metric_mask AND problem_idx IS NOT NULL AS BIGINT) AS metric_mask
FROM enc WHERE split = 'test' AND student_idx IS NOT NULL""")
def phase_rows(spark, d):
    t = Tutor(spark, d)
    masked = t.canonical.select("seq", "metric_mask")
    rows = t.encoded.join(masked, "seq").where(F.col("split") == "test")
    return as_long(V.kt1_phase_rows(rows, "test").select("seq", "problem_idx", "metric_mask"), "metric_mask")


@query("execution_rows", KT1 + """
SELECT interaction_id, 'irt' AS family, '' AS tag_idxs FROM canon UNION ALL SELECT interaction_id, 'ar_kt', array_to_string(kc_ids, ',') FROM canon""")
def execution_rows(spark, d):
    """Rows for a family without KCs and for one with."""
    rows = Kt1(spark, d).canonical.withColumn("tag_idxs", F.col("kc_ids"))
    irt, ar_kt = (V.execution_rows(rows, f).select("interaction_id", F.lit(f).alias("family"), text("tag_idxs").alias("tag_idxs")) for f in ("irt", "ar_kt"))
    return irt.union(ar_kt)


@query("leakage", KT1 + """
SELECT learner_id FROM splitrows WHERE split IN ('train', 'valid') INTERSECT SELECT learner_id FROM splitrows WHERE split = 'test'""")
def leakage(spark, d):
    rows = Kt1(spark, d).prepared
    return V.leaked_learners(V.fitted_rows(rows), rows.where(F.col("split") == "test"), "learner_id")


@query("missing_learners", """
SELECT CAST(c_custkey AS VARCHAR) AS learner_id FROM customer EXCEPT SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT'""")
def missing_learners(spark, d):
    """Customers without an urgent order."""
    cohort = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("learner_id"))
    seen = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("string").alias("learner_id"))
    return V.missing_learners(cohort, seen)


@query("fitted_population", KT1 + "SELECT DISTINCT learner_id FROM splitrows WHERE split IN ('train', 'valid')")
def fitted_population(spark, d):
    rows = Kt1(spark, d).prepared
    return V.fitted_population(rows.where(F.col("split") == "train"), rows.where(F.col("split") == "valid"))


# --- sampling and caps ---------------------------------------------------------------------


@query("cohort_prefix", "SELECT DISTINCT c_name FROM customer ORDER BY c_name LIMIT 50")
def cohort_prefix(spark, d):
    return A.first_ids(table(spark, d, "customer"), "c_name", 50)


@query("hash_sample", """
SELECT c_name FROM (SELECT DISTINCT c_name FROM customer) ORDER BY sha256('42:' || c_name), c_name LIMIT 50""")
def hash_sample(spark, d):
    return A.hash_sample(table(spark, d, "customer"), "c_name", 50, "42")


@query("mt_sample")
def mt_sample(spark, d):
    return A.seeded_sample(table(spark, d, "customer"), "c_name", 50, 42)


@query("cohort_rows", KT1 + """
SELECT interaction_id FROM canon WHERE learner_id IN (SELECT DISTINCT learner_id FROM canon ORDER BY learner_id LIMIT 20)""")
def cohort_rows(spark, d):
    rows = Kt1(spark, d).canonical
    return A.cohort_rows(rows, A.first_ids(rows, "learner_id", 20)).select("interaction_id")


@query("epoch_shuffle", """
SELECT c_name, row_number() OVER (ORDER BY sha256('7:3:' || c_name), c_name) - 1 AS position FROM customer""")
def epoch_shuffle(spark, d):
    return A.epoch_shuffle(table(spark, d, "customer"), "c_name", "7", 3)


@query("smoke_cap", KT1 + """
, b AS (SELECT learner_id, bundle_id, min(seq) AS f, count(*) AS n FROM contig GROUP BY ALL)
SELECT interaction_id FROM contig JOIN b USING (learner_id, bundle_id) WHERE f = 0 OR f + n <= 24""")
def smoke_cap(spark, d):
    k = Kt1(spark, d)
    return A.cap_whole_bundles(W.runs(k.contiguous, hot=k.hot), 24).select("interaction_id")


@query("first_rows", KT1 + "SELECT interaction_id FROM contig ORDER BY seq LIMIT 64")
def first_rows(spark, d):
    return A.first_rows(Kt1(spark, d).contiguous, 64).select("interaction_id")


# --- validation ----------------------------------------------------------------------------


def damaged(k: Kt1) -> DataFrame:
    """Canonical rows with known damage, one kind per residue of the event id."""
    c, m = k.canonical, F.col("seq") % 997
    on = lambda r, value, other: F.when(m == r, value).otherwise(other)
    return c.select(
        "seq",
        F.when(m == 8, F.concat("learner_id", F.lit(":0"))).when(m == 14, " ").otherwise(F.col("interaction_id")).alias("interaction_id"),
        on(1, F.lit(" "), F.col("learner_id")).alias("learner_id"),
        on(2, F.lit(""), F.col("item_id")).alias("item_id"),
        on(3, F.lit(2).cast("long"), F.col("correct")).alias("correct"),
        on(5, F.array_append("kc_ids", F.lit(-7).cast("long")), F.col("kc_ids")).alias("kc_ids"),
        F.when(m == 4, -1).when(m == 9, 0).otherwise(F.col("order")).cast("long").alias("order"),
        F.when(m == 6, F.lit(float("nan"))).when(m == 12, F.col("timestamp") - 1e9)
        .otherwise(F.col("timestamp").cast("double")).alias("timestamp"),
        F.when(m == 10, "u0|0").when(m == 11, F.concat("learner_id", F.lit("|0"))).when(m == 15, "").otherwise(F.col("bundle_id")).alias("bundle_id"),
        F.when(m == 7, " ").when(m == 13, "valid").otherwise("train").alias("split"),
        "metric_mask",
    )


_ROW_RULES = {
    "empty_learner_id": ("trim(learner_id) = ''", "NULL"),
    "empty_item_id": ("trim(item_id) = ''", "NULL"),
    "empty_interaction_id": ("trim(interaction_id) = ''", "NULL"),
    "empty_bundle_id": ("trim(bundle_id) = ''", "NULL"),
    "invalid_correct": ("correct NOT IN (0, 1)", "NULL"),
    "invalid_order": ("ord < 0", "NULL"),
    "empty_split": ("trim(split) = ''", "NULL"),
    "invalid_timestamp": ("isnan(ts)", "NULL"),
    "invalid_kc_id": ("list_contains(kc_ids, -7)", "NULL"),
}


def _row_rule(code: str) -> Callable:
    return lambda spark, d: L.row_issues(damaged(Kt1(spark, d))).where(F.col("code") == code).drop("message")


for _code, (_where, _key) in _ROW_RULES.items():
    query(f"validate_{_code}", issue(_code, _where, _key))(_row_rule(_code))


@query("validate_duplicate_interaction_id", DAMAGED + """
SELECT 'duplicate_interaction_id' AS code, CAST(NULL AS VARCHAR) AS learner_id, interaction_id AS key, interaction_id
FROM bad WHERE trim(interaction_id) <> '' GROUP BY interaction_id HAVING count(*) > 1""")
def validate_duplicate_interaction_id(spark, d):
    return L.duplicate_interaction_ids(damaged(Kt1(spark, d))).drop("message")


@query("validate_duplicate_learner_order", DAMAGED + """
SELECT 'duplicate_learner_order' AS code, learner_id, CAST(ord AS VARCHAR) AS key, interaction_id
FROM bad QUALIFY row_number() OVER (PARTITION BY learner_id, ord ORDER BY seq) > 1""")
def validate_duplicate_learner_order(spark, d):
    return L.duplicate_learner_orders(damaged(Kt1(spark, d))).drop("message")


_BUNDLE = DAMAGED + """
SELECT '{0}' AS code, CAST(NULL AS VARCHAR) AS learner_id, bundle_id AS key, CAST(NULL AS VARCHAR) AS interaction_id
FROM bad WHERE trim(bundle_id) <> '' GROUP BY bundle_id HAVING count(DISTINCT {1}) > 1"""


def _bundle_rule(code: str) -> Callable:
    return lambda spark, d: L.bundle_issues(damaged(Kt1(spark, d))).where(F.col("code") == code).drop("message")


query("validate_bundle_crosses_learner", _BUNDLE.format("bundle_crosses_learner", "learner_id"))(_bundle_rule("bundle_crosses_learner"))
query("validate_bundle_crosses_split", _BUNDLE.format("bundle_crosses_split", "split"))(_bundle_rule("bundle_crosses_split"))


@query("validate_bundle_not_contiguous", DAMAGED + """
, s AS (SELECT *, lag(bundle_id) OVER (PARTITION BY learner_id ORDER BY ord, seq) AS p FROM bad),
st AS (SELECT * FROM s WHERE p IS DISTINCT FROM bundle_id)
SELECT 'bundle_not_contiguous' AS code, learner_id, bundle_id AS key, interaction_id FROM st
QUALIFY row_number() OVER (PARTITION BY learner_id, bundle_id ORDER BY ord, seq) > 1""")
def validate_bundle_not_contiguous(spark, d):
    k = Kt1(spark, d)
    return L.contiguity_issues(damaged(k), k.hot).drop("message")


@query("validate_temporal_regression", DAMAGED + """
, s AS (SELECT *, last_value(CASE WHEN NOT isnan(ts) THEN ts END IGNORE NULLS) OVER (PARTITION BY learner_id ORDER BY ord, seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM bad)
SELECT 'temporal_regression' AS code, learner_id, CAST(ord AS VARCHAR) AS key, interaction_id FROM s WHERE NOT isnan(ts) AND ts < p""")
def validate_temporal_regression(spark, d):
    k = Kt1(spark, d)
    return L.temporal_issues(damaged(k), k.hot).drop("message")


@query("validate_duplicate_kc", DAMAGED + """
SELECT 'duplicate_kc_id' AS code, learner_id, array_to_string(kc_ids, ',') AS key, interaction_id
FROM bad WHERE len(kc_ids) <> len(list_distinct(kc_ids))""")
def validate_duplicate_kc(spark, d):
    return L.repeated_kc_report(damaged(Kt1(spark, d))).drop("message")


def _issues_in_all() -> str:
    """Issues per code, from the SQL of the single rules; a repeated KC is reported but is no issue."""
    rules = [sql.removeprefix(DAMAGED).strip() for name, sql in ORACLES.items() if name.startswith("validate_") and name != "validate_duplicate_kc"]
    parts = [f"SELECT code FROM ({'WITH ' + r[1:] if r.startswith(',') else r})" for r in rules]
    return DAMAGED + "SELECT code, count(*) AS issues FROM (" + "\nUNION ALL ".join(parts) + ") GROUP BY code"


@query("validate_summary", _issues_in_all())
def validate_summary(spark, d):
    k = Kt1(spark, d)
    return L.validate(cut_lineage(damaged(k)), hot=k.hot).groupBy("code").agg(F.count(F.lit(1)).alias("issues"))


@query("count_gate", KT1 + """
SELECT 'eligible_rows' AS counter, count(*) AS observed, CAST(-1 AS BIGINT) AS expected FROM canon""")
def count_gate(spark, d):
    """One counter that differs from what is expected and one that doesn't, of which only the first is reported."""
    n = table(spark, d, "events").count()
    return L.count_gate(C.filter_stats(Kt1(spark, d).marked), {"eligible_rows": -1, "raw_rows": n})


# --- diagnostics ---------------------------------------------------------------------------

_INVERSIONS = """
, inv AS (SELECT *, lag(ts_ms) OVER w AS pts, lag(solving_id) OVER w AS psolv, lag(solving_id) OVER w IS DISTINCT FROM solving_id AS st
          FROM {src} WINDOW w AS (PARTITION BY learner_id ORDER BY seq))"""


@query("diagnostics_kt1", KT1 + _INVERSIONS.format(src="canon") + """
, att AS (SELECT count(*) AS n, count(DISTINCT bundle_id) AS b FROM canon GROUP BY learner_id, item_id),
same AS (SELECT count(*) AS n FROM canon GROUP BY learner_id, ts_ms),
siz AS (SELECT count(*) AS n FROM canon GROUP BY learner_id, bundle_id)
SELECT (SELECT count(*) FROM ev) AS raw_rows, count(*) AS eligible_rows,
  count(*) FILTER (len(kc_ids) <> len(list_distinct(kc_ids))) AS duplicate_kc_rows,
  count(DISTINCT CASE WHEN len(kc_ids) <> len(list_distinct(kc_ids)) THEN item_id END) AS duplicate_kc_questions,
  count(*) FILTER (len(kc_ids) > 1) AS multi_kc_rows,
  """ + number("count(*) FILTER (len(kc_ids) > 1) / count(*)") + """ AS multi_kc_rate,
  count(*) FILTER (len(kc_ids) = 0) AS missing_kc_rows,
  """ + number("count(*) FILTER (len(kc_ids) = 0) / count(*)") + """ AS missing_kc_rate,
  count(*) FILTER (ts_ms < pts) AS timestamp_inversions, count(*) FILTER (solving_id < psolv) AS solving_id_inversions,
  (SELECT CAST(sum(n - 1) AS BIGINT) FROM att) AS repeated_question_attempt_rows,
  (SELECT count(*) FROM att WHERE b > 1) AS questions_repeated_across_bundles,
  (SELECT count(*) FROM same WHERE n > 1) AS duplicate_timestamp_groups,
  (SELECT count(*) FROM siz) AS bundle_count, (SELECT min(n) FROM siz) AS min_bundle_size, (SELECT max(n) FROM siz) AS max_bundle_size,
  (SELECT count(*) FROM ev) - count(*) AS filtered_rows FROM inv""")
def diagnostics_kt1(spark, d):
    k = Kt1(spark, d)
    raw = table(spark, d, "events").agg(F.count(F.lit(1)))
    out = D.kt1_diagnostics(k.canonical, raw, k.hot)
    return out.withColumn("multi_kc_rate", rounded("multi_kc_rate")).withColumn("missing_kc_rate", rounded("missing_kc_rate"))


@query("sequence_invariants", KT1 + _INVERSIONS.format(src="canon") + """
SELECT count(*) FILTER (st) - (SELECT count(*) FROM (SELECT DISTINCT learner_id, solving_id FROM canon)) AS noncontiguous_bundles,
       count(*) FILTER (st AND solving_id < psolv) AS solving_id_inversions,
       count(*) FILTER (ts_ms < pts) AS timestamp_inversions FROM inv""")
def sequence_invariants(spark, d):
    k = Kt1(spark, d)
    return D.sequence_invariants(k.canonical, k.hot)


@query("diagnostics_split", KT1 + _INVERSIONS.format(src="splitrows") + """
, siz AS (SELECT count(*) AS n FROM splitrows GROUP BY bundle_id)
SELECT (SELECT count(*) FROM ev) AS raw_rows, count(*) AS eligible_rows, count(DISTINCT learner_id) AS learner_count,
  count(DISTINCT item_id) AS item_count, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'valid') AS valid_rows,
  count(*) FILTER (split = 'test') AS test_rows, (SELECT count(DISTINCT k) FROM (SELECT unnest(kc_ids) AS k FROM splitrows)) AS real_kc_count,
  count(*) FILTER (len(kc_ids) = 0) AS missing_kc_rows, count(*) FILTER (len(kc_ids) > 1) AS multi_kc_rows,
  count(*) FILTER (len(kc_ids) <> len(list_distinct(kc_ids))) AS duplicate_kc_rows,
  (SELECT count(*) FROM siz) AS bundle_count, (SELECT min(n) FROM siz) AS min_bundle_size,
  """ + number("(SELECT sum(n) / count(*) FROM siz)") + """ AS mean_bundle_size, (SELECT max(n) FROM siz) AS max_bundle_size,
  count(*) FILTER (st) - (SELECT count(*) FROM (SELECT DISTINCT learner_id, solving_id FROM splitrows)) AS noncontiguous_bundles,
  count(*) FILTER (st AND solving_id < psolv) AS solving_id_inversions, count(*) FILTER (ts_ms < pts) AS timestamp_inversions,
  (SELECT count(*) FROM ev) - count(*) AS filtered_rows FROM inv""")
def diagnostics_split(spark, d):
    k = Kt1(spark, d)
    raw = table(spark, d, "events").agg(F.count(F.lit(1)))
    return D.split_diagnostics(k.prepared, raw, k.hot).withColumn("mean_bundle_size", rounded("mean_bundle_size"))


@query("diagnostics_tutor", TUTOR + """
, cr AS (SELECT bool_or(crossing) AS x, bool_or(split = 'train') AND bool_or(split = 'valid') AS y FROM closed GROUP BY student_id, ts)
SELECT (SELECT count(*) FROM tr) AS raw_rows, (SELECT count(*) FROM tr WHERE attempt <> 1) AS filtered_non_first_attempt,
  CAST(0 AS BIGINT) AS invalid_response_rows, CAST(0 AS BIGINT) AS missing_learner_rows, CAST(0 AS BIGINT) AS missing_item_rows,
  (SELECT count(*) FROM tr WHERE attempt = 1 AND skill_id = '') AS missing_kc_rows, count(*) AS eligible_rows,
  count(DISTINCT student_id) AS learners, count(DISTINCT problem_id) AS items, count(DISTINCT skill_id) AS kcs,
  count(DISTINCT student_id || '|' || ts) AS bundles, count(*) FILTER (split = 'train') AS train_rows,
  count(*) FILTER (split = 'valid') AS valid_rows, count(*) FILTER (split = 'test') AS test_rows,
  count(DISTINCT CASE WHEN split = 'train' THEN student_id || '|' || ts END) AS train_bundles,
  count(DISTINCT CASE WHEN split = 'valid' THEN student_id || '|' || ts END) AS valid_bundles,
  count(DISTINCT CASE WHEN split = 'train' THEN student_id END) AS n_train_users,
  count(DISTINCT CASE WHEN split = 'valid' THEN student_id END) AS n_valid_users,
  count(*) FILTER (metric_mask) AS metric_eligible_rows, count(*) FILTER (NOT metric_mask) AS oov_rows,
  CAST(0 AS BIGINT) AS multi_kc_rows, 0.0e0 AS multi_kc_rate, count(*) FILTER (promoted) AS promoted_to_valid,
  (SELECT count(*) FROM cr WHERE x) AS nominal_cross_boundary_bundles, (SELECT count(*) FROM cr WHERE y) AS derived_cross_boundary_bundles,
  (SELECT count(*) FROM vlearn) AS n_students_vocab, (SELECT count(*) FROM vitem) AS n_questions_vocab,
  (SELECT count(*) FROM vskill) AS n_skills_vocab, count(DISTINCT problem_id) AS n_questions_full, count(DISTINCT skill_id) AS n_skills_full
FROM enc""")
def diagnostics_tutor(spark, d):
    t = Tutor(spark, d)
    return D.tutor_diagnostics(t.marked, t.closed, t.canonical, t.learners, t.items, t.skills)


@query("bundle_sizes", KT1 + """
, siz AS (SELECT count(*) AS n FROM canon GROUP BY learner_id, bundle_id)
SELECT count(*) AS bundle_count, min(n) AS min_bundle_size, """ + number("sum(n) / count(*)") + """ AS mean_bundle_size, max(n) AS max_bundle_size FROM siz""")
def bundle_sizes(spark, d):
    return D.bundle_sizes(Kt1(spark, d).canonical).withColumn("mean_bundle_size", rounded("mean_bundle_size"))


@query("prediction_targets", KT1 + "SELECT count(*) AS targets FROM canon")
def prediction_targets(spark, d):
    return D.prediction_targets(Kt1(spark, d).canonical)


# --- identity ------------------------------------------------------------------------------

_JSON = """'{"interaction_id":"' || interaction_id || '","learner_id":"' || learner_id || '","item_id":"' || item_id || '","correct":' || correct
 || ',"kc_ids":[' || array_to_string(kc_ids, ',') || '],"order":' || ord || ',"timestamp":' || ts_ms || ',"bundle_id":"' || bundle_id
 || '","split":"' || split || '","metric_mask":true}'"""
_TREE = """
, l0 AS (SELECT {group} AS g, row_number() OVER (PARTITION BY {group} ORDER BY seq) - 1 AS a, {line} AS h FROM {src}),
l1 AS (SELECT g, a // 8192 AS a, sha256(string_agg(h, chr(10) ORDER BY a)) AS h, count(*) AS n FROM l0 GROUP BY g, a // 8192),
l2 AS (SELECT g, a // 8192 AS a, sha256(string_agg(h, chr(10) ORDER BY a)) AS h, sum(n) AS n FROM l1 GROUP BY g, a // 8192),
l3 AS (SELECT g, sha256(string_agg(h, chr(10) ORDER BY a)) AS tree_hash, CAST(sum(n) AS BIGINT) AS row_count FROM l2 GROUP BY g)
"""


@query("row_json", KT1 + f"SELECT seq, {_JSON} AS row_json FROM splitrows")
def row_json(spark, d):
    rows = Kt1(spark, d).split
    return rows.select("seq", I.row_json(rows).alias("row_json"))


@query("split_tree_hash", KT1 + _TREE.format(group="split", line=_JSON, src="splitrows") + "SELECT g AS split, tree_hash, row_count FROM l3")
def split_tree_hash(spark, d):
    rows = Kt1(spark, d).prepared
    return I.tree_hash(rows, I.row_json(rows), "split")


@query("damaged_leaves", KT1 + """
, l AS (SELECT split, seq, (row_number() OVER (PARTITION BY split ORDER BY seq) - 1) // 256 AS leaf FROM splitrows)
SELECT split, leaf, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS stored_rows, count(*) AS observed_rows
FROM l GROUP BY split, leaf HAVING count(*) FILTER (seq % 1009 = 0) > 0""")
def damaged_leaves(spark, d):
    """Leaves of a stored hash tree that no longer fit after one answer in 1,009 was turned over."""
    rows = Kt1(spark, d).prepared
    leaves = lambda df: I.tree_leaves(df, I.row_json(df), "split", fanout=256)
    turned = rows.withColumn("correct", F.when(F.col("seq") % 1009 == 0, 1 - F.col("correct")).otherwise(F.col("correct")))
    return I.damaged_leaves(cut_lineage(leaves(rows)), leaves(turned), "split")


@query("row_identity", KT1 + "SELECT interaction_id, concat_ws('|', learner_id, source_row, item_id, solving_id, ts_ms) AS row_identity FROM splitrows")
def row_identity(spark, d):
    made = Kt1(spark, d).split.select("interaction_id", S.row_identity().alias("r"))
    return made.select("interaction_id", F.concat_ws("|", *[F.col(f"r.{c}").cast("string") for c in ("user_id", "source_row", "question_id", "solving_id", "timestamp")]).alias("row_identity"))


_PROV = "concat_ws(',', learner_id, source_row, item_id, solving_id, ts_ms, split)"


@query("provenance_tree_hash", KT1 + _TREE.format(group="split", line=_PROV, src="splitrows") + "SELECT g AS split, tree_hash, row_count FROM l3")
def provenance_tree_hash(spark, d):
    rows = Kt1(spark, d).prepared
    return I.tree_hash(rows, I.provenance_line(rows), "split")


@query("vocab_tree_hash", TUTOR + """
, vs AS (SELECT 'items' AS kind, idx AS seq, id FROM vitem)""" + _TREE.format(group="kind", line="id", src="vs") + "SELECT g AS kind, tree_hash, row_count FROM l3")
def vocab_tree_hash(spark, d):
    v = Tutor(spark, d).items.select(F.lit("items").alias("kind"), F.col("idx").alias("seq"), "id")
    return I.tree_hash(v, F.col("id"), "kind")


@query("identity_mismatches", KT1 + _TREE.format(group="split", line=_JSON, src="splitrows") + """
SELECT g AS split, tree_hash AS stored_hash, row_count AS stored_rows, CAST(NULL AS VARCHAR) AS observed_hash, CAST(NULL AS BIGINT) AS observed_rows
FROM l3 WHERE g = 'test'""")
def identity_mismatches(spark, d):
    rows = Kt1(spark, d).prepared
    stored = I.tree_hash(rows, I.row_json(rows), "split")
    return I.identity_mismatches(stored, stored.where(F.col("split") != "test"))


# --- simple scoring ------------------------------------------------------------------------

_COUNT = """, scored AS (SELECT *, 1.0e0 / (1 + min(ord) OVER (PARTITION BY learner_id, bundle_id)) AS p FROM splitrows)"""
_MASK = "(seq % 10 <> 3)"
_AUC = """, rk AS (SELECT {g} AS g, correct, rank() OVER (PARTITION BY {g} ORDER BY p) AS lo,
        count(*) OVER (PARTITION BY {g}, p) AS ties, p FROM {src}),
m AS (SELECT g, avg(-(correct * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (1 - correct) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12)))) AS nll,
        avg((p - correct) * (p - correct)) AS brier, count(*) AS n, sum(correct) AS pos,
        sum(CASE WHEN correct = 1 THEN lo + (ties - 1) / 2.0e0 ELSE 0 END) AS sr FROM rk GROUP BY g)
"""
_AUC_OUT = (number("nll") + " AS nll, " + number("brier") + " AS brier, "
            + number("CASE WHEN pos = 0 OR pos = n THEN 0.5e0 ELSE (sr - pos * (pos + 1) / 2.0e0) / (pos * (n - pos)) END") + " AS auc, n")


def scored_rows(spark: SparkSession, d: str) -> DataFrame:
    k = Kt1(spark, d)
    rows = R.count_baseline(k.split, k.hot)
    return rows.withColumn("metric_mask", F.col("seq") % 10 != 3)


def metric_columns(df: DataFrame, *lead: str) -> DataFrame:
    return df.select(*lead, rounded("nll").alias("nll"), rounded("brier").alias("brier"), rounded("auc").alias("auc"), "n")


@query("count_baseline", KT1 + _COUNT + "SELECT interaction_id, " + number("p") + " AS probability FROM scored")
def count_baseline(spark, d):
    return scored_rows(spark, d).select("interaction_id", rounded("probability").alias("probability"))


@query("metrics_masked", KT1 + _COUNT + f", ms AS (SELECT * FROM scored WHERE {_MASK})" + _AUC.format(g="1", src="ms") + f"SELECT {_AUC_OUT} FROM m")
def metrics_masked(spark, d):
    return metric_columns(M.masked_metrics(scored_rows(spark, d)))


@query("metrics_by_split", KT1 + _COUNT + f", ms AS (SELECT * FROM scored WHERE {_MASK})" + _AUC.format(g="split", src="ms") + f"SELECT g AS split, {_AUC_OUT} FROM m")
def metrics_by_split(spark, d):
    return metric_columns(M.masked_metrics(scored_rows(spark, d), group=["split"]), "split")


@query("auc_by_learner", KT1 + _COUNT + _AUC.format(g="learner_id", src="scored") + f"SELECT g AS learner_id, {_AUC_OUT} FROM m")
def auc_by_learner(spark, d):
    return metric_columns(M.score(scored_rows(spark, d), group=["learner_id"]), "learner_id")


@query("metrics_exact_sums", KT1 + _COUNT + f", ms AS (SELECT * FROM scored WHERE {_MASK})" + _AUC.format(g="1", src="ms") + "SELECT " + number("nll") + " AS nll, " + number("brier") + " AS brier, n FROM m")
def metrics_exact_sums(spark, d):
    out = M.deterministic_losses(scored_rows(spark, d))
    return out.select(rounded("nll").alias("nll"), rounded("brier").alias("brier"), "n")


@query("metrics_gate", KT1 + _COUNT + f", ms AS (SELECT * FROM scored WHERE {_MASK})" + _AUC.format(g="1", src="ms") + f"SELECT {_AUC_OUT}, unnest([0, 1])::BIGINT AS ok FROM m")
def metrics_gate(spark, d):
    """Both answers of the gate: expected values that can't be met, and those of the rows themselves."""
    found = cut_lineage(M.masked_metrics(scored_rows(spark, d)))
    met = found.select("nll", "brier", "auc").first().asDict()
    gates = [M.within_tolerance(found, want) for want in ({"nll": 0.0, "brier": 0.0, "auc": float("nan")}, met)]
    return metric_columns(gates[0].union(gates[1]), "ok").withColumn("ok", F.col("ok").cast("long"))


@query("early_stop", KT1 + """,
ep AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS k
       FROM (SELECT learner_id AS run, solving_id AS epoch, avg(correct) AS auc, CAST(count(*) AS DOUBLE) AS nll, CAST(min(ord) AS DOUBLE) AS brier FROM canon GROUP BY 1, 2)),
st AS (SELECT run, k, epoch, auc, auc AS best_auc, epoch AS best_epoch, CAST(0 AS BIGINT) AS waited, false AS stop, nll AS best_nll, brier AS best_brier FROM ep WHERE k = 1
       UNION ALL
       SELECT e.run, e.k, e.epoch, e.auc, CASE WHEN up THEN e.auc ELSE best_auc END, CASE WHEN up THEN e.epoch ELSE best_epoch END,
              CASE WHEN up THEN 0 ELSE waited + 1 END, NOT up AND waited + 1 >= 5, CASE WHEN up THEN e.nll ELSE best_nll END, CASE WHEN up THEN e.brier ELSE best_brier END
       FROM (SELECT st.*, ep.auc > best_auc + 0.001e0 AS up FROM st JOIN ep ON ep.run = st.run AND ep.k = st.k + 1 WHERE NOT stop) s JOIN ep e ON e.run = s.run AND e.k = s.k + 1)
SELECT run, epoch, auc, best_auc, best_epoch, waited, stop, best_nll, best_brier FROM st""")
def early_stop(spark, d):
    """Daily success rate per learner read as an epoch curve, one run per learner."""
    k = Kt1(spark, d)
    epochs = k.canonical.groupBy(F.col("learner_id").alias("run"), F.col("solving_id").alias("epoch")).agg(
        F.avg("correct").alias("auc"), F.count(F.lit(1)).cast("double").alias("nll"), F.min("order").cast("double").alias("brier"))  # any two carried columns
    return M.early_stop(epochs, 0.001, 5)
