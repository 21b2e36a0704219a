"""Rows without an id, repeated ids, and user columns with any name come through every stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenseq.llm import backoff_lm, language_id, mixing, near_copies, quality, simhash, word_bpe

NAMES = ["_text", "_row", "_language", "_words", "_quality", "doc", "found", "name", "draw", "times", "cdf", "_mix_source", "Copyright notice", "text_"]


def prose(seed, n, words):
    rng = random.Random(seed)
    return "".join(" ".join(rng.choice(words).capitalize() if i == 0 else rng.choice(words) for i in range(10)) + ".\n" for _ in range(n))


EN = [a + b for a in ("the", "stone", "river", "light", "water", "garden", "house") for b in ("", "s", "ing", "ly", "er", "wise")]
DE = [a + b for a in ("der", "stein", "fluss", "licht", "wasser", "garten", "haus") for b in ("", "e", "ung", "lich", "keit", "heit")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i % 3 == 0 else i // 2, prose(i, 12, EN if i % 2 else DE), "en" if i % 2 else "de", f"s{i % 2}", i) for i in range(60)] + [(1000, "", "en", "s0", 0), (1001, None, None, None, 0)]
    made = spark.createDataFrame([(*r, *[f"{n} {i}" for n in NAMES]) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))
    return made.repartition(3).cache()


def same_columns(before, after):
    """Every row of ``after`` has the values of one row of ``before`` in all user columns."""
    assert after.columns == before.columns
    known = {tuple(r[n] for n in NAMES) for r in before.collect()}
    rows = after.collect()
    assert rows and all(tuple(r[n] for n in NAMES) in known for r in rows)
    return rows


def test_stages_keep_columns_and_rows_without_ids(spark, docs):
    kept = corpus_pipeline.known_language(spark, docs, "")
    assert len(same_columns(docs, kept)) == 60
    kept = quality.kept_documents(docs)
    assert len(same_columns(docs, kept)) == 60
    assert len(same_columns(docs, near_copies.representatives(docs))) == 61  # the empty texts are copies
    assert len(same_columns(docs, simhash.representatives(docs))) == 61
    same_columns(docs, corpus_pipeline.mixed(spark, docs, ""))
    assert corpus_pipeline.packed(spark, docs, "").count() >= 62


def test_mixing_draws_rows_without_ids_apart(spark):
    rows = [(None, f"text {i}", "s") for i in range(2000)] + [(7, f"other {i}", "t") for i in range(2000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights={"s": 1.0, "t": 1.0})
    times = [r["count"] for r in got.groupBy("source").count().collect()]
    assert len(times) == 2 and all(1800 < n < 2200 for n in times)
    assert got.select("text").distinct().count() > 2300


def test_mixing_without_broadcast(spark, monkeypatch, docs):
    want = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert sorted(map(str, mixing.mix(docs).collect())) == want


def test_language_of_number_signs(spark):
    rows = [(i, prose(i, 6, EN if i % 2 else DE), "en" if i % 2 else "de") for i in range(80)] + [(None, prose(900 + i, 6, EN), "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.lit(True))
    odd = spark.createDataFrame([(1, "½ ② ① 12"), (2, "x²"), (3, "_ __ 3"), (4, "der stein ½")], "doc_id long, text string")
    found = {r.doc_id: r._language for r in language_id.identify(odd, model).collect()}
    assert [found[i].lang_pred == "und" for i in (1, 2, 3, 4)] == [True, False, True, False] and found[1].rejected and found[1].score == 0


def test_rows_that_share_an_id_are_scored_apart(spark):
    rows = [(None, f"a b {i}") for i in range(50)] + [(5, f"b c {i}") for i in range(50)]
    got = backoff_lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False))
    assert got.count() == 100 and {r.train_tokens for r in got.collect()} == {400}


def test_split_of_all_characters_equals_the_library():
    path = word_bpe.default_path()
    rng = random.Random(5)
    pool = "abcABC'sSxyzÉéßİıΣςσ“”—…’ЖжЙй中文日本語ก็👍🏽é̂½²①ͅ \t\n\r\x0b\x1c\x1f\x85\xa0 \x00,.!<|>0123٣"
    draw = lambda n: "".join(rng.choice(pool) for _ in range(rng.randint(0, n)))
    texts = [draw(60) + rng.choice(["", "<|endoftext|>", "<|startoftext|>it's <|endoftext|>", "<|x"]) + draw(30) for _ in range(1500)]
    want = [word_bpe.library(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in word_bpe.IdCache(path, entries=500).encode(texts)] == want
    assert [sum((word_bpe.encode_piece(path, p) for p in word_bpe.pieces(path, t)), []) for t in texts] == want
