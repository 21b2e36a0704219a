"""Canonical views derived from the star-schema tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseq.functions import scalars as S
from lumenseq.operators import cleaning as C
from lumenseq.operators import splits as P
from lumenseq.operators import vocab as V
from lumenseq.operators.layout import HotKeys, Running, densify, hot_keys, ordinal, prefix_by_int, scan
from lumenseq.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass
class Kt1:
    """Response log with bundles: one learner per ``events`` user."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def _events(self) -> DataFrame:
        return table(self.spark, self.sf_dir, "events").selectExpr(
            "event_id as seq",
            "concat('u', user_id) as user_id",
            "cast(timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) as string) as timestamp",
            "cast(datediff(ts, '2024-01-01') as string) as solving_id",
            "concat('q', get_json_object(props, '$.k')) as question_id",
            "CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' WHEN 'purchase' THEN 'c' WHEN 'signup' THEN 'd' ELSE '' END as user_answer",
        )

    @cached_property
    def hot(self) -> HotKeys:
        """Learners above the hot threshold, found once per query."""
        learners = table(self.spark, self.sf_dir, "events").select(
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("learner_id")
        )
        return hot_keys(learners, ["learner_id"])

    @cached_property
    def raw(self) -> DataFrame:
        renamed = HotKeys(("user_id",), self.hot.rows, self.hot.width,
                          type(self.hot.schema)([self._events.schema["user_id"]]))
        return scan(self._events, ["user_id"], "seq", [Running("source_row", "count")], renamed)

    @cached_property
    def questions(self) -> DataFrame:
        pair = "concat_ws(';', regexp_extract(p_brand, '([0-9]+)', 1), p_size)"
        return table(self.spark, self.sf_dir, "part").where("p_partkey % 10 <> 9").selectExpr(
            "concat('q', p_partkey) as question_id",
            f"""CASE p_type WHEN 'SMALL' THEN '-1' WHEN 'ECONOMY' THEN concat_ws(';', {pair}, regexp_extract(p_brand, '([0-9]+)', 1))
                ELSE {pair} END as tags""",
            "element_at(array('a', 'b', 'c', 'd'), cast(p_partkey % 4 + 1 as int)) as correct_answer",
        )

    @cached_property
    def catalog(self) -> DataFrame:
        return C.question_catalog(self.questions)

    @cached_property
    def asked(self) -> DataFrame:
        """The catalog entries that the log names, written once.

        Rows are joined to this table by its measured size: a log that names few items of a large catalog is not shuffled by them.
        """
        named = self._events.select(F.expr(S.cell_sql("question_id")).alias("question_id")).distinct()
        return cut_lineage(self.catalog.join(named, "question_id", "left_semi"))

    @cached_property
    def marked(self) -> DataFrame:
        return C.kt1_drop_reason(self.raw, self.asked)

    @cached_property
    def canonical(self) -> DataFrame:
        """Eligible canonical rows; ``seq`` is the raw source position."""
        return C.kt1_to_canonical(C.eligible(self.marked), self.hot)

    @cached_property
    def stored(self) -> DataFrame:
        """The canonical rows written once; numbering and splits read them several times, their columns only."""
        return cut_lineage(self.canonical)

    @cached_property
    def contiguous(self) -> DataFrame:
        """Canonical rows with ``seq`` renumbered learner by learner (numeric user order)."""
        rows = self.stored.withColumn("_user", F.substring("learner_id", 2, 20).cast("long"))
        sizes = rows.groupBy("_user").agg(F.count(F.lit(1)).alias("_n"))
        offsets = prefix_by_int(sizes, "_user", F.col("_n"), "_offset").select("_user", "_offset")
        joined = rows.join(offsets, "_user")
        return joined.select(
            (F.col("_offset") + F.col("order")).cast("long").alias("seq"),
            *[c for c in self.canonical.columns if c != "seq"],
        )

    @cached_property
    def dense(self) -> DataFrame:
        """Canonical rows in source order with ``seq`` renumbered without gaps."""
        return densify(self.stored, "seq")

    @cached_property
    def split(self) -> DataFrame:
        return P.solving_split(self.contiguous, self.hot)

    @cached_property
    def prepared(self) -> DataFrame:
        """The split rows written once, for queries that read them several times."""
        return cut_lineage(self.split)


def tutor_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-attempt tutor log shape from orders, lineitem and part, as text columns.

    Rows are joined and numbered with narrow values; the text is made of them afterwards.
    """
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    # both unknown when their source is, so that ``otherwise`` below decides as it would on the source itself
    items = table(spark, sf_dir, "lineitem").select(*keys, (F.col("l_returnflag") == "R").alias("_wrong"))
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(o_orderdate AS TIMESTAMP_NTZ))").alias("_seconds"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_type") == "PROMO", "").otherwise(F.col("p_brand")).alias("skill_id"))
    joined = items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).join(parts, items["l_partkey"] == parts["p_partkey"])
    rows = joined.select(*keys, "o_custkey", "skill_id", "_wrong", "_seconds")
    numbered = ordinal(rows, keys, "source_row", ["l_partkey", "l_linenumber", "o_custkey", "skill_id", "_wrong", "_seconds"])
    return numbered.select(
        F.col("o_custkey").cast("string").alias("student_id"),
        F.col("l_partkey").cast("string").alias("problem_id"),
        "skill_id",
        F.when(F.col("_wrong"), "0").otherwise("1").alias("correct"),
        F.col("_seconds").cast("string").alias("timestamp"),
        F.when(F.col("l_linenumber") > 6, "2").otherwise("1").alias("attempt_count"),
        "source_row",
    )


@dataclass
class TutorLog:
    """First-attempt tutor log from raw text rows with ``source_row``."""

    raw: DataFrame

    @cached_property
    def marked(self) -> DataFrame:
        return C.tutor_drop_reason(self.raw)

    @cached_property
    def ordered(self) -> DataFrame:
        """Eligible rows in global (student, timestamp, source row) order."""
        return C.tutor_order(C.eligible(self.marked))

    @cached_property
    def hot(self) -> HotKeys:
        return hot_keys(self.ordered, ["student_id"])

    @cached_property
    def nominal(self) -> DataFrame:
        return P.temporal_row_split(self.ordered, "student_id", self.hot)

    @cached_property
    def closed(self) -> DataFrame:
        """Closed split labels, written once because three vocabularies read them."""
        return cut_lineage(P.bundle_closure(self.nominal, ["student_id", "timestamp"]))

    @cached_property
    def learners(self) -> DataFrame:
        return V.vocabulary(V.fitted_rows(self.closed), F.col("student_id").cast("string"))

    @cached_property
    def items(self) -> DataFrame:
        return V.vocabulary(V.fitted_rows(self.closed), F.col("problem_id").cast("string"))

    @cached_property
    def skills(self) -> DataFrame:
        return V.vocabulary(V.fitted_rows(self.closed), F.col("skill_id"))

    @cached_property
    def encoded(self) -> DataFrame:
        rows = self.closed.withColumn("learner_id", F.col("student_id").cast("string")).withColumn(
            "item_id", F.col("problem_id").cast("string")
        )
        rows = V.encode(rows, self.learners, "learner_id", "student_idx")
        rows = V.encode(rows, self.items, "item_id", "problem_idx")
        return V.encode(rows, self.skills, "skill_id", "skill_idx")

    @cached_property
    def canonical(self) -> DataFrame:
        known = F.col("student_idx").isNotNull() & F.col("problem_idx").isNotNull() & F.col("skill_idx").isNotNull()
        return self.encoded.select(
            "seq",
            F.concat(F.lit("assist17:"), F.col("seq").cast("string")).alias("interaction_id"),
            "learner_id",
            "item_id",
            "correct",
            F.when(F.col("skill_idx").isNotNull(), F.array("skill_idx")).otherwise(F.array().cast("array<bigint>")).alias("kc_ids"),
            F.col("seq").alias("order"),
            F.col("timestamp").cast("double").alias("timestamp"),
            F.concat_ws("|", "learner_id", F.col("timestamp").cast("string")).alias("bundle_id"),
            "split",
            (F.col("split").isin("train", "valid") | known).alias("metric_mask"),
            "source_row",
            "skill_id",
        )


def Tutor(spark: SparkSession, sf_dir: str) -> TutorLog:
    """One student per ``orders`` customer."""
    return TutorLog(tutor_raw(spark, sf_dir))
