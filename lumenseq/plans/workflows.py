"""Whole workflows composed from the operators: prepare, fit, evaluate, user models."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseq.operators import align
from lumenseq.operators import cleaning as C
from lumenseq.operators import diagnose as D
from lumenseq.operators import identity as I
from lumenseq.operators import metrics as M
from lumenseq.operators import replay as R
from lumenseq.operators import sampling as A
from lumenseq.operators import splits as P
from lumenseq.operators import validate as L
from lumenseq.operators import vocab as V
from lumenseq.operators.fit import train
from lumenseq.operators.fitted import FittedModel, check_fitted, table_digest
from lumenseq.operators.layout import ordinal
from lumenseq.operators.models import B_LR, ETA_R, L2, THETA_LR, AbilityModel, BundleModel, ResidualModel, check_model
from lumenseq.operators.windows import runs
from lumenseq.plans.tables import TutorLog
from lumenseq.session import cut_lineage
from lumenseq.sources import files, sealed, sinks


#: Labels that enter the identity of a published dataset; a changed rule takes a new one.
PROTOCOL = "solving_split_v1"
PREPROCESSING = "canonical_rows_v2"


class WorkflowError(RuntimeError):
    """A gate of a workflow failed; nothing was published or scored past it."""


def _require_empty(df: DataFrame, what: str) -> None:
    found = df.limit(3).collect()
    if found:
        raise WorkflowError(f"{what}: {[r.asDict() for r in found]}")


def _tree(df: DataFrame) -> list[dict]:
    """Hash and row count per split; three rows."""
    return [r.asDict() for r in I.tree_hash(df, I.row_json(df), "split").orderBy("split").collect()]


def _raw_hash(*hashed: DataFrame) -> str | None:
    """Tree hash over name and SHA-256 of every raw file, in the order of the names: a changed file changes the identity."""
    every = hashed[0]
    for more in hashed[1:]:
        every = every.unionByName(more)
    found = I.tree_hash(ordinal(every, ["name", "sha256"], "seq").withColumn("g", F.lit(0)), F.concat_ws(":", "name", "sha256"), "g").first()
    return found["tree_hash"] if found else None


def _dropped(marked: DataFrame) -> DataFrame:
    return marked.where("drop_reason IS NOT NULL").groupBy(F.col("drop_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _identity(rows: DataFrame, dataset_id: str, cohort: DataFrame | None, raw: str | None = None, **vocabularies: DataFrame) -> dict:
    """Splits with hash and count, hashes of each vocabulary and of the raw files, and the document that binds them."""
    def ordered(vocab: DataFrame) -> str | None:
        found = I.tree_hash(vocab.select(F.lit(0).alias("g"), F.col("idx").alias("seq"), "id"), F.col("id").cast("string"), "g").first()
        return found["tree_hash"] if found else None

    splits = _tree(rows)
    hashes = {name: ordered(vocab) for name, vocab in vocabularies.items()}
    members = ordered(ordinal(cohort.select(F.col(cohort.columns[0]).alias("id")), ["id"], "idx")) if cohort is not None else None
    _, logical = I.dataset_identity(dataset_id, PROTOCOL, PREPROCESSING, members,
                                    [(s["split"], s["tree_hash"], s["row_count"]) for s in splits],
                                    hashes["items"], hashes["kcs"])
    return {"splits": splits, "vocabularies": hashes, "cohort": members, "raw_files": raw, "logical_hash": logical}


def prepare_kt1(spark: SparkSession, raw_dir: str, questions: str, out: str, pilot: tuple[int, int] | None = None,
                cohort: int | None = None, expected: dict[str, int] | None = None, rebuild: bool = False) -> tuple[str, dict]:
    """Per-learner logs to a published dataset.

    ``pilot`` is (size, seed) of the sampled population that defines the
    vocabulary, ``cohort`` the number of pilot learners whose rows are kept.
    """
    population = files.kt1_user_ids(spark, raw_dir)
    chosen = A.seeded_sample(population, "user_id", *pilot).select("user_id") if pilot else population
    chosen = cut_lineage(chosen)
    raw = files.read_kt1_user_dir(spark, raw_dir, chosen if pilot else None).withColumn("seq", F.col("source_row"))
    marked = cut_lineage(C.kt1_drop_reason(raw, files.read_questions(spark, questions)))
    canonical = C.kt1_to_canonical(C.eligible(marked))
    labelled = ordinal(P.solving_split(canonical), ["learner_id", "order"], "seq")
    fitted = V.fitted_rows(labelled)
    items, kcs = V.vocabulary(fitted, F.col("item_id")), V.kc_vocabulary(fitted)
    rows, kept, members = labelled, marked, chosen
    if cohort is not None:
        members = cut_lineage(A.first_ids(chosen.withColumnRenamed("user_id", "learner_id"), "learner_id", cohort))
        rows = densify_cohort(A.cohort_rows(labelled, members))
        kept = A.cohort_rows(marked, members)
        _require_empty(V.missing_learners(members, rows), "cohort learners without rows")
    _require_empty(L.validate(rows, check_temporal=False, check_bundle_contiguity=False).drop("message"), "invalid rows")
    invariants = D.sequence_invariants(rows).first().asDict()
    if any(invariants.values()):
        raise WorkflowError(f"sequence invariants broken: {invariants}")
    summary = D.split_diagnostics(rows, kept.agg(F.count(F.lit(1))))
    if expected:
        _require_empty(L.count_gate(summary, expected), "frozen counts differ")
    rows, items, kcs = cut_lineage(rows), cut_lineage(items), cut_lineage(kcs)
    read = files.hash_files(spark, raw_dir, "u*.csv").join(members.select(F.concat(F.col(members.columns[0]), F.lit(".csv")).alias("name")), "name", "left_semi")
    identity = _identity(rows, "kt1", members, _raw_hash(read, files.hash_files(spark, questions)), items=items, kcs=kcs)

    def write(path: str) -> None:
        sinks.write_splits(rows, f"{path}/rows")
        items.write.parquet(f"{path}/items")
        kcs.write.parquet(f"{path}/kcs")
        sinks.write_manifest(spark, f"{path}/manifest.json", identity, summary,
                             V.oov_counts(rows.where(F.col("split") == "test"), items), dropped=_dropped(kept))

    return sinks.publish_if_changed(spark, out, identity, write, rebuild), identity


def densify_cohort(rows: DataFrame) -> DataFrame:
    """Renumber the kept learners without gaps so run detection sees no interruptions."""
    return ordinal(rows, ["seq"], "seq")


def prepare_tutor(spark: SparkSession, csv: str, out: str, expected: dict[str, int] | None = None,
                  rebuild: bool = False) -> tuple[str, dict]:
    """Tutor CSV to a published dataset with closed bundles and TRAIN+VALID vocabularies."""
    log = TutorLog(files.read_tutor_csv(spark, csv))
    rows = cut_lineage(log.canonical)
    _require_empty(L.validate(V.fitted_rows(rows)).drop("message"), "invalid TRAIN/VALID rows")
    summary = D.tutor_diagnostics(log.marked, log.closed, rows, log.learners, log.items, log.skills)
    if expected:
        _require_empty(L.count_gate(summary, expected), "frozen counts differ")
    if summary.first()["derived_cross_boundary_bundles"]:
        raise WorkflowError("bundle closure left a TRAIN/VALID crossing bundle")
    identity = _identity(rows, "tutor", None, _raw_hash(files.hash_files(spark, csv)), learners=log.learners, items=log.items, kcs=log.skills)

    def write(path: str) -> None:
        sinks.write_splits(rows, f"{path}/rows", extra=("source_row", "skill_id"))
        for name, vocab in (("learners", log.learners), ("items", log.items), ("skills", log.skills)):
            vocab.write.parquet(f"{path}/{name}")
        sinks.write_manifest(spark, f"{path}/manifest.json", identity, summary, dropped=_dropped(log.marked))

    return sinks.publish_if_changed(spark, out, identity, write, rebuild), identity


def _model(kind: str, rule: str, eta: float = ETA_R, theta_lr: float = THETA_LR, l2: float = L2) -> tuple[BundleModel, ResidualModel | None]:
    if kind == "irt":
        return AbilityModel(theta_lr, l2), None
    if kind == "ar_kt":
        residual = ResidualModel(rule=rule, eta=eta, theta_lr=theta_lr, l2=l2, tags="tag_idxs")
        return residual, residual
    raise ValueError(f"model kind must be irt or ar_kt, got {kind!r}")


def _scores(trace: DataFrame) -> dict:
    found = M.masked_metrics(trace).collect()
    return found[0].asDict() if found else {}


def _global_scores(trace: DataFrame) -> dict:
    return _scores(trace.withColumn("probability", F.col("p_global")))


def _vocabularies(rows: DataFrame, learners: DataFrame | None, items: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The vocabularies given, else those of the TRAIN and VALID rows."""
    fitted = V.fitted_rows(rows)
    learners = V.vocabulary(fitted, F.col("learner_id")) if learners is None else learners
    items = V.vocabulary(fitted, F.col("item_id")) if items is None else items
    return cut_lineage(learners.select("id", "idx")), cut_lineage(items.select("id", "idx"))


def fit_valid(rows: DataFrame, kind: str, rule: str = "token", state_path: str | None = None,
              learners: DataFrame | None = None, items: DataFrame | None = None, eta: float = ETA_R,
              theta_lr: float = THETA_LR, b_lr: float = B_LR, l2: float = L2) -> dict:
    """TRAIN pass, optional state save, VALID pass with difficulty frozen, masked metrics.

    Masked rows and rows outside the vocabularies neither train nor validate. The saved state names the rates it was trained with.
    """
    model, residual = _model(kind, rule, eta, theta_lr, l2)
    known = _vocabularies(rows, learners, items)
    fit = train(ordinal(R.phase_input(rows, "train", *known), ["seq"], "seq"), residual=residual, theta_lr=theta_lr, b_lr=b_lr, l2=l2)
    states = cut_lineage(R.states_of(fit.walked))
    if state_path:
        sinks.save_state(states, fit.difficulty, state_path, kind, rule, eta, theta_lr, b_lr, l2)
    valid = ordinal(R.phase_input(rows, "valid", *known, fit.difficulty), ["seq"], "seq")
    trace = R.trace_of(cut_lineage(R.replay(valid, model, states, keep=("interaction_id", "correct", "metric_mask"))))
    out = {"valid": _scores(trace), "sweeps": fit.sweeps, "step": fit.step}
    if kind == "ar_kt":
        out["valid_global"] = _global_scores(trace)
    return out


def _gate(trace: DataFrame, expected: dict, tolerance: float, what: str) -> dict:
    found = M.within_tolerance(M.masked_metrics(trace), expected, tolerance).collect()
    if not found or not found[0]["ok"]:
        raise WorkflowError(f"{what} replay gate failed: {[g.asDict() for g in found]}")
    return found[0].asDict()


def _same_identity(stored: DataFrame, rows: DataFrame) -> None:
    observed = I.tree_hash(rows, I.row_json(rows), "split")
    _require_empty(I.identity_mismatches(stored, observed), "dataset identity differs")


def evaluate_test(rows: DataFrame, kind: str, state_path: str, expected_valid: dict, expected_global: dict | None = None,
                  tolerance: float = M.HEADLINE_TOLERANCE, stored_identity: DataFrame | None = None,
                  learners: DataFrame | None = None, items: DataFrame | None = None) -> dict:
    """Gate on identity and on the VALID metrics, then continue into TEST.

    Update rule and rates come from the saved header. ``ar_kt`` is gated on ``p_global`` as well. No job reads TEST rows before
    the gates have passed; then hash and count of TEST are held against ``stored_identity`` before anything is scored.
    """
    if kind == "ar_kt" and expected_global is None:
        raise ValueError("ar_kt is gated on p_global too: give expected_global")
    is_test = F.col("split") == "test"
    if stored_identity is not None:
        _same_identity(stored_identity.where(~is_test), rows.where(~is_test))
    header, states, difficulty = sinks.load_state(rows.sparkSession, state_path, kind)
    model, _ = _model(kind, header["rule"], header["eta"], header["theta_lr"], header["l2"])
    known = _vocabularies(rows, learners, items)
    keep = ("interaction_id", "correct", "metric_mask")
    part = lambda s: ordinal(R.phase_input(rows, s, *known, difficulty), ["seq"], "seq")
    valid = cut_lineage(R.replay(part("valid"), model, states, keep=keep))
    out = {"valid": _gate(R.trace_of(valid), expected_valid, tolerance, "VALID")}
    if kind == "ar_kt":
        on_global = R.trace_of(valid).withColumn("probability", F.col("p_global"))
        out["valid_global"] = _gate(on_global, expected_global, tolerance, "VALID p_global")
    if stored_identity is not None:
        _same_identity(stored_identity.where(is_test), rows.where(is_test))
    moved = R.states_of(valid)
    carried = moved.unionByName(states.join(moved.select("learner_id").distinct(), "learner_id", "left_anti"))
    trace = R.trace_of(cut_lineage(R.replay(part("test"), model, carried, keep=keep)))
    out["test"] = _scores(trace)
    if kind == "ar_kt":
        out["test_global"] = _global_scores(trace)
    return out


@dataclass
class UserRun:
    """Result of a user model on TRAIN then VALID."""

    predictions: DataFrame
    metrics: dict
    trace_hash: list[dict]
    states: DataFrame | None
    identity: dict | None = None


def _trace_hash(predictions: DataFrame) -> list[dict]:
    """Hash and row count of the predictions of each split."""
    return [r.asDict() for r in I.tree_hash(predictions, I.trace_line(), "split").orderBy("split").collect()]


def run_user_model(rows: DataFrame, model: BundleModel, roles: list[tuple[str, str]], oov_semantics: str | None = None,
                   phase_state: str = "carry", test: bool = False) -> UserRun:
    """TRAIN then VALID (and, on request, TEST) through a user model with all contract checks.

    ``phase_state`` ``carry`` continues TEST from the VALID states, ``independent``
    restarts it from the TRAIN-only states.
    """
    check_model(model, oov_semantics)
    if phase_state not in ("carry", "independent"):
        raise ValueError(f"phase_state must be carry or independent, got {phase_state!r}")
    fitting, scoring = P.role_rows(rows, roles, "train"), P.role_rows(rows, roles, "valid")
    held_out = [s for s, r in roles if r == "test"]
    if held_out:
        _require_empty(V.leaked_learners(fitting.unionByName(scoring), P.role_rows(rows, roles, "test")), "TEST ids in fitting rows")
    keep = ("interaction_id", "correct", "metric_mask", "split")
    trained = cut_lineage(R.states_of(R.replay(fitting, model)))
    walked = cut_lineage(R.replay(scoring, model, trained, keep=keep))
    target, states = scoring, R.states_of(walked)
    # a second VALID pass from the stored TRAIN states must give the same predictions: the model keeps nothing outside its state
    first, second = (_trace_hash(R.trace_of(w)) for w in (walked, R.replay(scoring, model, trained, keep=keep)))
    if first != second:
        raise WorkflowError(f"VALID replay from restored states differs: {first} against {second}")
    if test:
        entering = trained
        if phase_state == "carry":
            entering = states.unionByName(trained.join(states.select("learner_id").distinct(), "learner_id", "left_anti"))
        target = P.role_rows(rows, roles, "test")
        walked = cut_lineage(R.replay(target, model, entering, keep=keep))
    predictions = R.trace_of(walked)
    _require_empty(align.misaligned(target.select("seq", "interaction_id"), predictions.select("seq", "interaction_id")), "misaligned predictions")
    return UserRun(predictions, _scores(predictions), _trace_hash(predictions) if test else first, states)


def run_user_directory(spark: SparkSession, directory: str, model: BundleModel) -> UserRun:
    """User model on a canonical directory: declaration, id files, validation, membership, then the run and the data's identity."""
    data = files.read_directory(spark, directory)
    declared, data.rows = data.declared, cut_lineage(data.rows)
    check_model(model, declared["oov_representation_semantics_id"])
    _require_empty(L.validate(data.rows).drop("message"), "invalid dataset")
    _require_empty(P.outside_declared_splits(data.rows, declared["split_order"]).select("interaction_id", "split"), "undeclared split")
    run = run_user_model(data.rows, model, declared["split_roles"], declared["oov_representation_semantics_id"])
    run.identity = sealed.directory_identity(data)
    return run


def _stored_checkpoint(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """Tables of a stored checkpoint and its document; a table that no longer has its digest is an error."""
    document = sinks.read_json(spark, f"{path}/checkpoint.json")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in document["tables"]}
    for name, table in tables.items():
        if table_digest(table) != document["tables"][name]:
            raise WorkflowError(f"checkpoint table {name!r} differs from the one that training stored")
    return document, tables


def _fitted_phase(spark: SparkSession, build: Callable[[], FittedModel], path: str, rows: DataFrame, scored: DataFrame) -> DataFrame:
    """Predictions of ``scored`` by a fresh model over ``rows`` from the stored checkpoint, which must be the same before and after."""
    document, tables = _stored_checkpoint(spark, path)
    model = build()
    if model.metadata != document["metadata"]:
        raise WorkflowError(f"checkpoint was trained by {document['metadata']}, not by {model.metadata}")
    found = cut_lineage(model.replay(rows, tables).select("seq", "interaction_id", "probability"))
    _stored_checkpoint(spark, path)
    foreign = found.join(rows.select("seq"), "seq", "left_anti")
    _require_empty(foreign, "predictions of rows that were not given")
    found = found.join(scored.select("seq"), "seq", "left_semi")
    _require_empty(align.misaligned(scored.select("seq", "interaction_id"), found.select("seq", "interaction_id")), "misaligned predictions")
    off = ~F.coalesce(F.col("probability").between(0.0, 1.0), F.lit(False)) | F.isnan("probability")
    _require_empty(found.where(off), "probabilities outside 0 to 1")
    return scored.select("seq", "split", "correct", "metric_mask").join(found, "seq")


def run_fitted_model(rows: DataFrame, build: Callable[[], FittedModel], roles: list[tuple[str, str]], path: str,
                     oov_semantics: str | None = None) -> UserRun:
    """Train on TRAIN, store the checkpoint under ``path``, replay VALID twice, each time by a fresh model from storage.

    ``build`` makes a new model, so nothing but the checkpoint passes from training to replay. Both replays must agree, and the
    tables must have the digests that training stored.
    """
    spark, model = rows.sparkSession, build()
    check_fitted(model, oov_semantics)
    fitting, scoring = P.role_rows(rows, roles, "train"), P.role_rows(rows, roles, "valid")
    held_out = [s for s, r in roles if r == "test"]
    if held_out:
        _require_empty(V.leaked_learners(fitting.unionByName(scoring), P.role_rows(rows, roles, "test")), "TEST ids in fitting rows")
    digests = {}
    for name, table in model.train(fitting).items():
        table.write.parquet(f"{path}/{name}")
        digests[name] = table_digest(spark.read.parquet(f"{path}/{name}"))
    sinks.write_json(spark, f"{path}/checkpoint.json", {"metadata": model.metadata, "tables": digests})
    first, second = (_fitted_phase(spark, build, path, scoring, scoring) for _ in range(2))
    hashes = [_trace_hash(p) for p in (first, second)]
    if hashes[0] != hashes[1]:
        raise WorkflowError(f"VALID replay from the checkpoint differs: {hashes[0]} against {hashes[1]}")
    return UserRun(first, _scores(first), hashes[0], None)


def evaluate_fitted_model(rows: DataFrame, build: Callable[[], FittedModel], roles: list[tuple[str, str]], path: str,
                      expected_trace: list[dict], phase_state: str = "carry") -> UserRun:
    """TEST from the stored checkpoint: VALID is replayed first and must give ``expected_trace``; no job reads TEST rows before that.

    ``phase_state`` ``carry`` replays VALID and TEST in one pass, so TEST continues from what VALID left; ``independent`` starts
    TEST from the checkpoint alone.
    """
    if phase_state not in ("carry", "independent"):
        raise ValueError(f"phase_state must be carry or independent, got {phase_state!r}")
    check_fitted(build())
    spark, valid = rows.sparkSession, P.role_rows(rows, roles, "valid")
    again = _trace_hash(_fitted_phase(spark, build, path, valid, valid))
    if again != expected_trace:
        raise WorkflowError(f"VALID replay gate failed: {again} against {expected_trace}")
    test = P.role_rows(rows, roles, "test")
    found = _fitted_phase(spark, build, path, valid.unionByName(test) if phase_state == "carry" else test, test)
    return UserRun(found, _scores(found), _trace_hash(found), None)


def inspect_canonical(rows: DataFrame, max_rows: int | None = None) -> tuple[DataFrame, dict]:
    """Model-free replay of the bundle pre-state with optional whole-bundle cap, and its counts."""
    _require_empty(L.validate(rows).drop("message"), "invalid dataset")
    placed = ordinal(rows, ["learner_id", "order"], "seq")
    marked = runs(placed)
    if max_rows is not None:
        marked = A.cap_whole_bundles(marked, max_rows)
    steps = marked.select("interaction_id", "learner_id", "bundle_id", "order", F.col("revealed").alias("pre_bundle_update_count"))
    counts = marked.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("learner_id").alias("learners"),
                        F.countDistinct("run_first_seq").alias("bundles")).first().asDict()
    return steps, counts


def smoke(rows: DataFrame, kind: str, path: str, n: int = 24, rule: str = "token") -> dict:
    """TRAIN pass over the first rows in stored order, metrics and written predictions."""
    _, residual = _model(kind, rule)
    few = cut_lineage(ordinal(A.first_rows(rows, n), ["seq"], "seq"))
    fit = train(few, residual=residual)
    trace = R.trace_of(fit.walked).join(few.select("seq", "bundle_id", "split", "order", "kc_ids"), "seq")
    sinks.write_predictions(trace, path, kind, 0)
    return _scores(trace)
