import json

import pytest
from pyspark.sql import functions as F

from lumenseq.operators import identity as I
from lumenseq.operators import validate as L
from lumenseq.operators.models import REQUIRED_METADATA, AbilityModel, CountModel
from lumenseq.plans import workflows
from lumenseq.sources import files, sealed, sinks

QUESTIONS = """question_id,bundle_id,explanation_id,correct_answer,part,tags
q1,b1,e1,a,1,5;2;182
q2,b1,e1,b,1,-1
q3,,e2,c,1, 7; ;7
"""
HEADER = "timestamp,solving_id,question_id,user_answer,elapsed_time\n"


def kt1_dir(tmp_path, learners=4, rows=12):
    raw = tmp_path / "raw"
    raw.mkdir()
    for u in range(learners):
        lines = [f"{1000 + 10 * i},{1 + i // 2},q{1 + (i + u) % 3},{'abcd'[(i * (u + 1)) % 4]},5" for i in range(rows)]
        lines[3] = lines[3].rsplit(",", 2)[0] + ",,5"
        (raw / f"u{u}.csv").write_text(HEADER + "\n".join(lines) + "\n\n")
    (raw / "notes.csv").write_text("x\n1\n")
    (tmp_path / "questions.csv").write_text(QUESTIONS)
    return str(raw), str(tmp_path / "questions.csv")


def test_kt1_directory_rows(spark, tmp_path):
    raw, questions = kt1_dir(tmp_path)
    rows = files.read_kt1_user_dir(spark, raw)
    got = {(r["user_id"], r["source_row"]): r["user_answer"] for r in rows.collect()}
    assert len(got) == 48 and {k[0] for k in got} == {"u0", "u1", "u2", "u3"}
    assert got["u0", 3] in (None, "")
    catalog = {r["question_id"]: r for r in files.read_questions(spark, questions).collect()}
    assert catalog["q1"]["kc_ids"] == [5, 2, 182] and catalog["q2"]["kc_ids"] == [] and catalog["q3"]["kc_ids"] == [7, 7]
    assert catalog["q3"]["content_bundle_id"] is None


def test_csv_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text("user_id,timestamp\nu1,1\n")
    with pytest.raises(files.SourceError):
        files.read_kt1_csv(spark, str(tmp_path / "a.csv"))
    (tmp_path / "q.csv").write_text("question_id,tags\nq1,1\nq1,2\n")
    with pytest.raises(files.SourceError):
        files.read_questions(spark, str(tmp_path / "q.csv"))
    (tmp_path / "t.csv").write_text("question_id,tags\nq1,5;-1;2\n")
    with pytest.raises(Exception, match="invalid token"):
        files.read_questions(spark, str(tmp_path / "t.csv"))


def test_numbered_lines_over_many_blocks(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("".join(f"line-{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.numbered_lines(spark, str(path))
        assert rows.rdd.getNumPartitions() >= 1
        assert {r["line"]: r["value"] for r in rows.collect()} == {i: f"line-{i}" for i in range(5000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_prepare_kt1_publish(spark, tmp_path):
    raw, questions = kt1_dir(tmp_path)
    out = str(tmp_path / "out")
    status, identity = workflows.prepare_kt1(spark, raw, questions, out, pilot=(3, 42), cohort=2)
    assert status == "prepared" and sum(s["row_count"] for s in identity["splits"]) == 22
    assert workflows.prepare_kt1(spark, raw, questions, out, pilot=(3, 42), cohort=2)[0] == "reused"
    with pytest.raises(files.SourceError):
        workflows.prepare_kt1(spark, raw, questions, out, cohort=1)
    assert workflows.prepare_kt1(spark, raw, questions, out, cohort=1, rebuild=True)[0] == "prepared"
    with pytest.raises(workflows.WorkflowError):
        workflows.prepare_kt1(spark, raw, questions, out, cohort=1, expected={"eligible_rows": 5})
    valid = files.read_prepared(spark, f"{out}/rows", "valid", ["interaction_id", "seq"])
    assert valid.columns == ["interaction_id", "seq"]
    assert all("split=valid" in f for f in valid.inputFiles()) or "PartitionFilters" in valid._jdf.queryExecution().toString()
    manifest = sinks.read_json(spark, f"{out}/manifest.json")
    assert set(manifest["identity"]["vocabularies"]) == {"items", "kcs"} and len(manifest["identity"]["logical_hash"]) == 64
    # another vocabulary of the same size is another dataset
    other = {**manifest["identity"], "vocabularies": {**manifest["identity"]["vocabularies"], "items": "0" * 64}}
    with pytest.raises(files.SourceError):
        sinks.publish_if_changed(spark, out, other, lambda path: None)
    assert manifest["noncontiguous_bundles"] == 0 and manifest["eligible_rows"] == 11


def test_prepare_tutor_closure(spark, tmp_path):
    lines = ["student_id,problem_id,skill_id,correct,timestamp,attempt_count,extra"]
    stamps = [1, 2, 3, 4, 5, 6, 7, 7, 8, 9]
    for i, t in enumerate(stamps):
        lines.append(f"10,{100 + i if i < 9 else 999},s{i % 2},{i % 2},{t},1,x")
    lines += ["10,1,s0,1,1,2,x", "x,1,s0,1,1,1,x", "10,y,s0,1,1,1,x", "10,1,s0,3,1,1,x", "10,1,,1,1,1,x"]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "t")
    status, identity = workflows.prepare_tutor(spark, str(tmp_path / "a.csv"), out)
    assert status == "prepared"
    doc = sinks.read_json(spark, f"{out}/manifest.json")
    assert (doc["raw_rows"], doc["eligible_rows"], doc["train_rows"], doc["valid_rows"], doc["test_rows"]) == (15, 10, 6, 2, 2)
    assert (doc["promoted_to_valid"], doc["nominal_cross_boundary_bundles"], doc["oov_rows"]) == (1, 1, 2)
    assert [doc[k] for k in ("filtered_non_first_attempt", "missing_learner_rows", "missing_item_rows", "invalid_response_rows", "missing_kc_rows")] == [1] * 5


def canonical_dir(spark, tmp_path, mutate=None):
    d = tmp_path / "canon"
    d.mkdir()
    toy = files.toy_interactions(spark)
    lines = [r["value"] for r in files.interactions_to_json(toy).orderBy("seq").collect()]
    if mutate:
        lines = mutate(lines)
    (d / "interactions.jsonl").write_text("".join(x + "\n" for x in lines))
    declaration = {k: "x" for k in files.DECLARATION_REQUIRED} | files.DECLARATION_VERSIONS
    declaration |= {"split_order": ["train", "valid"], "split_roles": {"train": "train", "valid": "valid"}, "provenance": {}}
    (d / "declaration.json").write_text(json.dumps(declaration))
    (d / "learner_ids.txt").write_text("eve\nann\nbob\n")
    (d / "item_ids.txt").write_text("fractions-1\nfractions-2\nangles-1\nangles-2\nroots-1\n")
    (d / "kc_ids.txt").write_text("21\n3\n8\n11\n")
    return str(d), declaration


def test_canonical_round_trip(spark, tmp_path):
    directory, _ = canonical_dir(spark, tmp_path)
    rows = files.read_canonical(spark, directory)
    assert sorted(map(str, rows.collect())) == sorted(map(str, files.toy_interactions(spark).collect()))
    assert L.is_valid(rows)


@pytest.mark.parametrize("edit,text", [
    (lambda x: x[:2] + [""] + x[2:], "line 3 is blank"),
    (lambda x: ["{oops"] + x[1:], "line 1"),
    (lambda x: [x[0].replace('"order"', '"rank"')] + x[1:], "unknown fields"),
    (lambda x: [x[0].replace('"correct":0', '"correct":"yes"')] + x[1:], "wrong type"),
    (lambda x: [x[0].replace('"interaction_id":"ann-0"', '"interaction_id":7')] + x[1:], "line 1 has a field of the wrong type"),
    (lambda x: [x[0].replace('"learner_id":"ann"', '"learner_id":true')] + x[1:], "wrong type"),
    (lambda x: [x[0].replace('"item_id":"fractions-1"', '"item_id":{"a":1}')] + x[1:], "wrong type"),
    (lambda x: [x[0].replace('"split":"train"', '"split":5')] + x[1:], "wrong type"),
])
def test_canonical_line_errors(spark, tmp_path, edit, text):
    directory, _ = canonical_dir(spark, tmp_path, edit)
    with pytest.raises(Exception, match=text):
        files.read_canonical(spark, directory).collect()


def test_user_model_directory(spark, tmp_path):
    directory, _ = canonical_dir(spark, tmp_path)
    model = CountModel()
    model.metadata = dict.fromkeys(REQUIRED_METADATA, "v1")
    run = workflows.run_user_directory(spark, directory, model)
    assert run.metrics["n"] == 1 and run.predictions.first()["probability"] == pytest.approx(0.25)
    steps, counts = workflows.inspect_canonical(files.toy_interactions(spark), 3)
    assert counts == {"rows": 3, "learners": 1, "bundles": 2} and steps.count() == 3


def test_declaration_checks(spark, tmp_path):
    directory, declaration = canonical_dir(spark, tmp_path)
    for change in ({"surprise": 1}, {"canonical_schema_version": "v0"}, {"split_roles": {"train": "train", "valid": "train"}}):
        (tmp_path / "canon" / "declaration.json").write_text(json.dumps(declaration | change))
        with pytest.raises(ValueError):
            files.read_declaration(spark, directory)


def test_ordered_ids_and_hashes(spark, tmp_path):
    import hashlib
    (tmp_path / "ids.txt").write_text("b\na\nc\n")
    ids = files.read_ordered_ids(spark, str(tmp_path / "ids.txt"))
    assert [r["id"] for r in ids.orderBy("idx").collect()] == ["b", "a", "c"]
    got = {r["name"]: r["sha256"] for r in files.hash_files(spark, str(tmp_path), "*.txt").collect()}
    assert got == {"ids.txt": hashlib.sha256(b"b\na\nc\n").hexdigest()}
    (tmp_path / "dup.txt").write_text("b\nb\n")
    with pytest.raises(files.SourceError):
        files.read_ordered_ids(spark, str(tmp_path / "dup.txt"))


def test_roles_prune_files(spark, tmp_path):
    path = str(tmp_path / "roles")
    sinks.write_roles(files.toy_interactions(spark), path, [("train", "train"), ("valid", "valid")])
    part = files.read_role(spark, path, "valid")
    assert part.count() == 1
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(role" in plan
    with pytest.raises(Exception, match="undeclared split"):
        sinks.write_roles(files.toy_interactions(spark), str(tmp_path / "bad"), [("train", "train")])


def test_fit_evaluate_round_trip(spark, tmp_path):
    rows = []
    for u in range(4):
        for i in range(15):
            split = "train" if i < 9 else "valid" if i < 12 else "test"
            rows.append((u * 15 + i, f"i{u}-{i}", f"u{u}", f"q{(i * 7 + u) % 5}", (i + u) % 2, [i % 3], i, float(i), f"u{u}|{i // 3}", split, True, [i % 3]))
    df = spark.createDataFrame(rows, "seq long, interaction_id string, learner_id string, item_id string, correct long, kc_ids array<long>, order long, timestamp double, bundle_id string, split string, metric_mask boolean, tag_idxs array<long>")
    state = str(tmp_path / "state")
    out = workflows.fit_valid(df, "ar_kt", state_path=state)
    assert out["valid"]["n"] == 12 and out["step"] <= 1e-13
    stored = I.tree_hash(df, I.row_json(df), "split")
    done = workflows.evaluate_test(df, "ar_kt", state, out["valid"], out["valid_global"], stored_identity=stored)
    assert done["test"]["n"] == done["test_global"]["n"] == 12
    wrong = {"nll": 0.0, "brier": 0.0, "auc": 0.0}
    for gates in ((wrong, out["valid_global"]), (out["valid"], wrong)):
        with pytest.raises(workflows.WorkflowError, match="gate failed"):
            workflows.evaluate_test(df, "ar_kt", state, *gates)
    with pytest.raises(ValueError, match="p_global"):
        workflows.evaluate_test(df, "ar_kt", state, out["valid"])
    swapped = df.withColumn("correct", F.when(F.col("split") == "test", 1 - F.col("correct")).otherwise(F.col("correct")))
    with pytest.raises(workflows.WorkflowError, match="identity differs"):
        workflows.evaluate_test(swapped, "ar_kt", state, out["valid"], out["valid_global"], stored_identity=stored)
    with pytest.raises(ValueError):
        sinks.load_state(spark, state, "irt")
    # an unknown item is scored under the first vocabulary item and masked, an unknown learner goes
    odd = df.withColumns({"item_id": F.when(F.col("seq") == 14, "new").otherwise(F.col("item_id")),
                          "learner_id": F.when((F.col("split") == "test") & (F.col("learner_id") == "u3"), "u9").otherwise(F.col("learner_id"))})
    assert workflows.evaluate_test(odd, "ar_kt", state, out["valid"], out["valid_global"])["test"]["n"] == 8
    b = {r["item_id"]: r["b"] for r in spark.read.parquet(f"{state}/b").collect()}
    vocab = workflows._vocabularies(odd, None, None)
    seen = {r["seq"]: r["b"] for r in workflows.R.phase_input(odd, "test", *vocab, spark.read.parquet(f"{state}/b")).collect()}
    assert seen[14] == b["q0"] != 0.0 and len(seen) == 9 and seen[13] == b["q1"]
    assert workflows.smoke(df, "irt", str(tmp_path / "smoke"))["n"] == 24


def test_directory_with_id_files(spark, tmp_path):
    directory, declared = canonical_dir(spark, tmp_path)
    data = files.read_directory(spark, directory)
    assert [r["id"] for r in data.learners.orderBy("idx").collect()] == ["eve", "ann", "bob"]
    first = sealed.directory_identity(data)
    assert set(first) == {"splits", "vocabularies", "logical_hash", "contract_hash"}
    kcs = tmp_path / "canon" / "kc_ids.txt"
    kcs.write_text("3\n21\n8\n11\n")  # another order is another dataset
    again = sealed.directory_identity(files.read_directory(spark, directory))
    assert again["logical_hash"] != first["logical_hash"] and again["vocabularies"]["items"] == first["vocabularies"]["items"]
    for text, message in (("3\n03\n", "canonical decimal"), ("3\n3\n", "repeated"), ("3\n\n4\n", "blank"), ("+3\n", "canonical decimal")):
        kcs.write_text(text)
        with pytest.raises(files.SourceError, match=message):
            files.read_directory(spark, directory)
    kcs.unlink()
    with pytest.raises(Exception, match="kc_ids"):
        files.read_directory(spark, directory)


def sealed_rows(spark):
    rows = [(i, f"i{i}", f"u{i % 7}", f"q{i % 5}", i % 2, [i % 3], i // 7, float(i), f"u{i % 7}|{i // 7}", ("train", "valid", "test")[min(i // 40, 2)], True) for i in range(120)]
    return spark.createDataFrame(rows, "seq long, interaction_id string, learner_id string, item_id string, correct long, kc_ids array<long>, order long, timestamp double, bundle_id string, split string, metric_mask boolean")


def test_sealed_roles(spark, tmp_path):
    rows, path = sealed_rows(spark), str(tmp_path / "sealed")
    declared = {k: "x" for k in files.DECLARATION_REQUIRED} | {"split_roles": [("train", "train"), ("valid", "valid"), ("test", "test")], "split_order": ["train", "valid", "test"]}
    items = spark.createDataFrame([(i, f"q{i}") for i in range(5)], "idx long, id string")
    document = sealed.write_sealed(rows, path, declared, fanout=8, items=items)
    assert {s["split"]: s["row_count"] for s in document["splits"]} == {"train": 40, "valid": 40, "test": 40}
    seal = sealed.open_sealed(spark, path)
    assert sorted(r["seq"] for r in sealed.read_sealed_role(seal, "valid").collect()) == list(range(40, 80))
    # a changed TEST row is named by its leaf, and VALID still reads
    changed = rows.withColumn("correct", F.when(F.col("seq") == 99, 1 - F.col("correct")).otherwise(F.col("correct")))
    assert [(r["leaf"], r["first_seq"], r["last_seq"]) for r in sealed.damage(seal, changed.where("split = 'test'"), "test").collect()] == [(2, 96, 103)]
    files_of = lambda df: df.where("split = 'test'").drop("role")
    target = f"{path}/rows/role=test"
    files_of(changed).write.mode("overwrite").parquet(target)
    with pytest.raises(files.SourceError, match=r"test.*leaf 2 \(seq 96 to 103\)"):
        sealed.read_sealed_role(sealed.open_sealed(spark, path), "test")
    assert sealed.read_sealed_role(seal, "valid").count() == 40
    rows.where("seq >= 79").write.mode("overwrite").parquet(target)
    with pytest.raises(files.SourceError, match="another split: .'i79'"):
        sealed.read_sealed_role(seal, "test")
    with pytest.raises(files.SourceError, match="not declared"):
        sealed.read_sealed_role(seal, "spare")
    for name, value in (("logical_hash", "0" * 64), ("contract_hash", "0" * 64), ("splits", document["splits"][:2])):
        stored = sinks.read_json(spark, f"{path}/sealed.json")
        sinks.write_json(spark, f"{path}/sealed.json", stored | {name: value})
        with pytest.raises(files.SourceError, match="sealed"):
            sealed.open_sealed(spark, path)
        sinks.write_json(spark, f"{path}/sealed.json", stored)
    stored = sinks.read_json(spark, f"{path}/sealed.json")
    sinks.write_json(spark, f"{path}/sealed.json", stored | {"declaration": stored["declaration"] | {"metric_mask_semantics": "other"}})
    with pytest.raises(files.SourceError, match="contract_hash"):
        sealed.open_sealed(spark, path)


def test_saved_rates_are_those_of_the_training(spark, tmp_path):
    rows = sealed_rows(spark).withColumn("tag_idxs", F.col("kc_ids"))
    out = workflows.fit_valid(rows, "ar_kt", state_path=str(tmp_path / "state"), theta_lr=0.2, b_lr=0.1, l2=0.0, eta=0.5)
    header = sinks.load_state(spark, str(tmp_path / "state"), "ar_kt")[0]
    assert (header["theta_lr"], header["b_lr"], header["l2"], header["eta"]) == (0.2, 0.1, 0.0, 0.5)
    assert workflows.evaluate_test(rows, "ar_kt", str(tmp_path / "state"), out["valid"], out["valid_global"])["valid"]["ok"]


def test_prepared_scan_refuses_a_foreign_split(spark, tmp_path):
    rows = sealed_rows(spark)
    rows.write.partitionBy("split").parquet(str(tmp_path / "good"))
    assert files.read_prepared(spark, str(tmp_path / "good"), "test").count() == 40
    rows.withColumn("split", F.when(F.col("seq") == 3, "spare").otherwise(F.col("split"))).write.partitionBy("split").parquet(str(tmp_path / "bad"))
    with pytest.raises(files.SourceError, match="foreign split 'spare'"):
        files.read_prepared(spark, str(tmp_path / "bad"), "test")


def test_csv_headers_and_named_files(spark, tmp_path, monkeypatch):
    raw, _ = kt1_dir(tmp_path)
    every = files.read_kt1_user_dir(spark, raw)
    learners = every.select("user_id").distinct().orderBy("user_id").limit(2)
    want = sorted(map(tuple, every.join(learners, "user_id", "left_semi").collect()))
    chosen = files.read_kt1_user_dir(spark, raw, learners)
    assert sorted(map(tuple, chosen.collect())) == want and want
    # the scan's own count of files: only the named ones are opened
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = files._text(spark, raw, "u*.csv", [f"{r[0]}.csv" for r in learners.collect()])._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        assert plan.collectLeaves().apply(0).metrics().apply("numFiles").value() == 2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    monkeypatch.setattr(files, "NAMED_FILES", 1)
    assert sorted(map(tuple, files.read_kt1_user_dir(spark, raw, learners).collect())) == want
    assert files.read_kt1_user_dir(spark, raw, learners.limit(1)).select("user_id").distinct().count() == 1
    (tmp_path / "raw2").mkdir()
    (tmp_path / "raw2" / "u1.csv").write_text(HEADER + "1,1,q1,a\n")
    (tmp_path / "raw2" / "u2.csv").write_text("\n" + HEADER.replace("timestamp", "time") + "1,1,q1,a\n")
    with pytest.raises(Exception, match="another header|lacks columns"):
        files.read_kt1_user_dir(spark, str(tmp_path / "raw2")).collect()
    (tmp_path / "empty.csv").write_text("\n\n")
    with pytest.raises(files.SourceError, match="no header"):
        files.read_kt1_csv(spark, str(tmp_path / "empty.csv"))


def test_fitted_model_checkpoint(spark, tmp_path):
    from pyspark.sql import functions as F
    from lumenseq.operators.fitted import ItemRateModel, table_digest

    roles = [("train", "train"), ("valid", "valid"), ("test", "test")]
    rows = spark.range(60).select(
        F.col("id").alias("seq"), F.concat(F.lit("i"), F.col("id")).alias("interaction_id"),
        F.concat(F.when(F.col("id") < 40, "a").otherwise("z"), (F.col("id") % 3).cast("string")).alias("learner_id"),
        F.concat(F.lit("b"), F.col("id")).alias("bundle_id"), F.concat(F.lit("q"), F.col("id") % 7).alias("item_id"), (F.col("id") % 2).alias("correct"),
        F.lit(True).alias("metric_mask"), F.when(F.col("id") < 30, "train").when(F.col("id") < 40, "valid").otherwise("test").alias("split"))
    path = str(tmp_path / "checkpoint")
    run = workflows.run_fitted_model(rows, ItemRateModel, roles, path)
    assert run.metrics["n"] == 10 and run.predictions.count() == 10
    test = workflows.evaluate_fitted_model(rows, ItemRateModel, roles, path, run.trace_hash)
    assert test.metrics["n"] == 20
    with pytest.raises(workflows.WorkflowError, match="gate"):
        workflows.evaluate_fitted_model(rows, ItemRateModel, roles, path, [])

    class Writes(ItemRateModel):
        def replay(self, rows, checkpoint):
            found = super().replay(rows, checkpoint)
            spark.createDataFrame([("q99", 1.0)], "item_id string, b double").write.mode("append").parquet(f"{path}2/items")
            return found

    class Short(ItemRateModel):
        def replay(self, rows, checkpoint):
            return super().replay(rows, checkpoint).where("seq % 5 <> 0")

    with pytest.raises(workflows.WorkflowError, match="misaligned"):
        workflows.run_fitted_model(rows, Short, roles, path + "1")
    with pytest.raises(workflows.WorkflowError, match="checkpoint table 'items' differs"):
        workflows.run_fitted_model(rows, Writes, roles, path + "2")
    # a table changed after VALID blocks TEST; the same rows in another order and layout do not
    stored = spark.createDataFrame(spark.read.parquet(f"{path}/items").collect())
    digest = table_digest(stored)
    stored.orderBy(F.desc("item_id")).repartition(3).write.mode("overwrite").parquet(f"{path}/items")
    assert table_digest(spark.read.parquet(f"{path}/items")) == digest
    assert workflows.evaluate_fitted_model(rows, ItemRateModel, roles, path, run.trace_hash, "independent").metrics["n"] == 20
    stored.withColumn("b", F.when(F.col("item_id") == "q3", 9.0).otherwise(F.col("b"))).write.mode("overwrite").parquet(f"{path}/items")
    with pytest.raises(workflows.WorkflowError, match="checkpoint table 'items' differs"):
        workflows.evaluate_fitted_model(rows, ItemRateModel, roles, path, run.trace_hash)
