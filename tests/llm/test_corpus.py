"""Corpus operators against plain versions, with nulls, empty, very long and repeated rows and clashing column names."""

import base64
import hashlib
import io
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lumenseq.llm import backoff_lm, components, language_id, licenses, mixing, multi_index, near_copies, packing, quality, simhash, token_counts, warc, word_bpe
from lumenseq.llm.common import id_remainder, pack_rows

LONG = "The quick brown fox, it's 12½ years old.\n" * 4000
TEXTS = [
    (0, "Licensed under the Apache License, Version 2.0."), (1, None), (2, ""), (3, " \n\t "), (4, LONG), (4, LONG), (None, "MIT license! mit-LICENSE"),
    (6, "Ünïcode Σας ΟΔΟΣ <|endoftext|> İx a\x1cb é 中文 it'S"), (7, "Released under the\nMIT License. gnu general PUBLIC license"), (8, "one two"),
    (9, "Plain words stand here, and they end well.\nHome | About | News | Contact\nAll rights reserved."), (10, "cc cc by by cc by"),
]
CLASH = "doc_id long, text string, lang string, source string, n_chars long, words string, copy long, fp string, bucket string, _text string, n string, cell string"


def table(spark, rows):
    made = [(i, t, None if i == 8 else "en", None if i == 2 else f"s{(i or 0) % 2}", len(t or ""), *["x"] * 1, 5, *["x"] * 5) for i, t in rows]
    return spark.createDataFrame(made, CLASH).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS).cache()


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0)


def tokens(text):
    return word_bpe.library(word_bpe.default_path()).encode(text or "", add_special_tokens=False).ids


def test_empty_tables(spark):
    none = table(spark, TEXTS).limit(0)
    for result in (
        licenses.license_scan(none), token_counts.token_counts(none), backoff_lm.lm_scores(none, F.lit(False)), packing.pack(none), mixing.mix(none),
        quality.line_quality(none), language_id.identify(none, language_id.fit(none, F.lit(True))), simhash.simhash_components(none), quality.kept_documents(none),
        warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")),
        multi_index.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)),
    ):
        assert result.count() == 0


def test_token_counts(docs):
    got = sorted(map(tuple, token_counts.token_counts(docs, limit=100).collect()), key=str)
    want = [(i, len((t or "").encode()), len(tokens(t)), len(tokens(t)) > 100) for i, t in TEXTS]
    assert got == sorted(want, key=str)


def test_token_cache_may_be_tiny(monkeypatch, docs):
    cache = word_bpe.IdCache(word_bpe.default_path(), entries=3)
    texts = [t or "" for _, t in TEXTS]
    assert [x.tolist() for x in cache.encode(texts)] == [tokens(t) for t in texts]


def test_packing(docs):
    rows = packing.pack(docs, size=64).collect()
    ids = {i: [*tokens(t), 1] for i, t in TEXTS}
    by_sequence = {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64 and at & (at - 1) == 0  # nothing to pad
    assert sum(r["length"] for r in rows) == sum(len(ids[i]) for i, _ in TEXTS)


def test_assign_balances_cost():
    rows = packing.assign([900, 700, 500, 300, 200, 100] * 20, 1024)
    load = Counter()
    for _, _, n, q, _ in rows:
        load[q] += n + n * n / 2048
    full = [v for q, v in load.items() if q < 2700 * 20 // 1024]
    assert max(full) < 1.5 * min(full)


def test_license_scan(docs):
    rows = {(r["doc_id"]): r for r in licenses.license_scan(docs).collect()}
    assert licenses.license_scan(docs).count() == len(TEXTS)
    assert rows[0]["base_labels"] == "apache" and rows[0]["labels"] == "apache,apache-2.0" and rows[0]["score"] == 1.0 and rows[0]["first_word"] == 3
    assert rows[1]["n_words"] == 0 and rows[1]["first_word"] is None and rows[1]["labels"] == ""
    assert rows[None]["n_base"] == 2 and (rows[None]["first_word"], rows[None]["last_word"]) == (0, 2)
    assert rows[7]["base_labels"] == "gpl,mit" and "mit-notice" in rows[7]["labels"]
    assert rows[10]["n_base"] == 2 and (rows[10]["first_word"], rows[10]["last_word"]) == (1, 4)
    assert rows[4]["n_words"] == 4000 * 9 and rows[4]["score"] == 0.0


def test_quality_matches_plain(docs):
    rows = quality.line_quality(docs).collect()
    for r in rows:
        text = dict(TEXTS)[r["doc_id"]] or ""
        words = text.encode().split()
        seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (len(words), len(covered), len(lines) - len(set(lines)))
        assert r["word_chars"] == sum(len(w.decode()) for w in words) and r["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>")
        assert r["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words)) and not (r["base_failed"] and r["kept"])
    assert next(r for r in rows if r["doc_id"] == 9)["clean_text"] == "Plain words stand here, and they end well."


def test_quality_keeps_clean_text(spark):
    clean = "\n".join(f"Sentence number {i} says something new about topic {i * 7}." for i in range(12))
    kept = quality.kept_documents(table(spark, [(1, clean), (2, clean + "\nHome | News | About"), (3, "a | b | c | d\n" * 10)])).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"], r["n_chars"]) for r in kept] == [(1, clean, len(clean)), (2, clean, len(clean))]


@pytest.mark.parametrize("bucket", [200, 10**7])
def test_language_model(docs, bucket):
    held = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 == 2
    got = backoff_lm.lm_scores(docs, held, mu=7.0, bucket_bytes=bucket, range_bytes=bucket).collect()
    split = lambda t: [*(t or "").encode().lower().split(), b""]
    train = [split(t) for i, t in TEXTS if (i or 0) % 3 != 2]
    c, pairs = Counter(w for t in train for w in t), Counter()
    for t in train:
        pairs.update(zip([None, *t], t, strict=False))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(TEXTS)
    for r in got:
        t = split(dict(TEXTS)[r["doc_id"]])
        base = [math.log10((c[w] + 1) / (n + v + 1)) for w in t]
        score = sum(math.log10((pairs[b, w] + 7 * 10**p) / ((c[b""] if b is None else c[b]) + 7)) for b, w, p in zip([None, *t], t, base, strict=False))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(base), rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_language_id(spark):
    english = ["the house and the garden are old", "this is what they were looking for", "there was nothing that anyone could say"]
    german = ["das haus und der garten sind alt", "dies ist was sie gesucht haben", "es gab nichts das jemand sagen konnte"]
    rows = [(i, (english if i % 2 else german)[i % 3] + f" {i}", "en" if i % 2 else "de") for i in range(300)]
    rows += [(900, None, "en"), (901, "", "de"), (902, "12 34 !!", "en"), (903, "the garden", None), (None, "der garten", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = id_remainder(F.col("doc_id"), 4) == 2
    found = {r["doc_id"]: r for r in language_id.identify(docs, language_id.fit(docs, ~held)).select("doc_id", "_language.*").collect()}
    assert all(found[i]["lang_pred"] == lang and not found[i]["rejected"] and 0 <= found[i]["score"] <= 1 for i, _, lang in rows[:300])
    assert all(found[i]["lang_pred"] == "und" and found[i]["rejected"] and found[i]["score"] == 0 for i in (900, 901, 902))
    assert found[903]["lang_pred"] == "en" and found[None]["lang_pred"] == "de"


def plain_components(texts):
    prints = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    label = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    return prints, label


def test_simhash(spark):
    base = " ".join(f"w{k}" for k in range(400))
    texts = [(i, t) for i, t in dict(TEXTS).items() if i is not None]
    texts += [(100 + i, base.replace("w7 ", f"v{i} ")) for i in range(12)] + [(200 + i, base) for i in range(5)]
    prints, label = plain_components(texts)
    got = {r["doc_id"]: r for r in simhash.simhash_components(table(spark, texts)).collect()}
    assert {i: f"{p:016x}" for i, p in prints.items()} == {i: r["fingerprint"] for i, r in got.items()}
    assert label == {i: r["component_id"] for i, r in got.items()}
    kept = sorted(r["doc_id"] for r in simhash.representatives(table(spark, texts + texts[:3])).collect())
    assert kept == sorted({label[i] for i, _ in texts})


def test_simhash_blocks(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 40, dtype="u8")
    prints = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << k) for k in range(6)], base ^ np.uint64(3 << 20)]))
    df = spark.createDataFrame([(int(x),) for x in prints.view("i8")], "fp long")
    links = simhash.near_links(df, owners=5, visitors=7)
    label = {int(r["a"]): int(r["b"]) for r in components.stars(links).collect()}
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 2
    root = np.arange(len(prints))
    for _ in prints:
        root = np.array([root[near[i]].min() for i in range(len(prints))])
    groups = {}
    for i, x in enumerate(prints.view("i8").tolist()):
        groups.setdefault(root[i], []).append(x)
    assert all(label.get(x, x) == min(g) for g in groups.values() for x in g)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "a long, b long")
    assert {(r["a"], r["b"]) for r in components.stars(links).collect()} == {(i, 0) for i in range(1, 41)} | {(100, 99)}


def test_mixing(spark, docs):
    many = spark.range(4000).selectExpr("id as doc_id", "'t' as text", "if(id % 10 = 0, 'rare', if(id % 10 = 1, null, 'common')) as source")
    got = mixing.mix(many, weights={"rare": 1.0, "common": 1.0})
    assert got.columns == ["doc_id", "text", "source", "copy", "mix_key"]
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert set(n) == {"rare", "common"} and abs(n["rare"] - 2000) < 300 and abs(n["common"] - 2000) < 300
    again = mixing.mix(many.repartition(7), weights={"rare": 1.0, "common": 1.0})
    assert sorted(map(tuple, got.select("doc_id", "copy").collect())) == sorted(map(tuple, again.select("doc_id", "copy").collect()))
    assert mixing.mix(docs).columns[-2:] == ["copy", "mix_key"]
    assert mixing.mix(docs, weights={}).count() == 0
    with pytest.raises(ValueError):
        mixing.source_rates(docs, {"s0": -1.0})


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\n", "same"), (5, None, "same"), (3, "http://c", "same"), (7, "u", None), (8, "u", ""), (9, "u", "é" * 400_000), (None, "u", "same"), (5, None, "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    html = {i: (h or "").encode() for i, _, h in rows}
    assert len(got) == len(rows)
    for r in got:
        data = html[r["page_id"]]
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == data
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got} == {
        (1, "revisit", 5), (3, "revisit", 5), (5, "response", None), (7, "revisit", 8), (8, "response", None), (9, "response", None), (None, "response", None)}
    small = {(r["page_id"], r["record_type"]) for r in warc.round_trip(pages, min_bytes=1).collect()}
    assert (7, "response") in small and (1, "revisit") in small


def test_warc_reader_refuses_damage():
    whole = warc.member(warc.record_bytes(1, "u", b"payload", None)) + warc.member(warc.record_bytes(2, "u", b"p" * 99, None))
    assert [p for _, _, p in warc.read_records(io.BytesIO(whole), read_bytes=3)] == [b"payload", b"p" * 99]
    plain = warc.record_bytes(1, "u", b"payload", None)
    for bad in (whole[:-30], warc.member(plain.replace(b"payload", b"pAyload")), warc.member(plain[:-4]), warc.member(plain + b"x"), warc.member(b"WARC/1.0" + plain[8:])):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_records(io.BytesIO(bad)))


def test_multi_index(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8)) * 3
    v = (centres[rng.integers(0, 20, 900)] + rng.normal(size=(900, 8)) * 0.2).astype("f4")
    v[500:700] = v[20]  # a large group of equal vectors
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] + [1.0] * 7), (2060, [None] + [1.0] * 7), (2080, [1.0]), (None, [1.0] * 8), (40, v[40].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in multi_index.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    x, hits = v.astype("f8"), 0
    ids = list(range(900)) + [40]
    x = np.vstack([x, x[40]])
    assert sorted(got) == list(range(0, 900, 20))
    for q, found in got.items():
        score = np.zeros(len(x))
        for d in range(8):
            score += x[:, d] * x[q, d]
        best = sorted(((-s, i) for s, i in zip(score, ids, strict=True) if i != q))[:20]
        hits += len({i for _, i in best} & {i for i, _ in found})
        assert [(-s, i) for i, s in found] == sorted((-s, i) for i, s in found) and len(found) == 20
    assert hits >= 0.9 * 20 * len(got)
    few = multi_index.search(df.where("vec_id in (0, 1, 3)"), F.col("vec_id") % 20 == 0).collect()
    assert {r["vec_id"] for r in few} == {1, 3}


def test_cells_in_order():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=6), rng.normal(size=5)
    order = [a[i] + b[j] for i, j in multi_index.cells_by_distance(a, b)]
    assert len(order) == 30 and order == sorted(order)


def test_pack_rows_keeps_all(spark):
    rows = spark.range(1000).selectExpr("cast(id % 7 as int) as bucket", "id", "repeat('x', cast(id % 50 as int)) as text")
    from lumenseq.llm.common import unpack_rows

    sizes = rows.transform(pack_rows).groupBy("bucket").applyInArrow(
        lambda t: t.select(["bucket"]).slice(0, 1).append_column("n", __import__("pyarrow").array([unpack_rows(t.column("rows")).num_rows])), "bucket int, n long")
    assert {r["bucket"]: r["n"] for r in sizes.collect()} == {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}


def test_pipeline_stages(spark, tmp_path):
    clean = [" ".join(f"word{(i * 37 + k * k) % 997} and" for k in range(60)) + "." for i in range(40)]
    rows = [(i, t) for i, t in enumerate(clean)] + [(50, clean[3]), (51, None), (52, "a | b | c\n" * 40), (53, clean[5].replace("word", "WORD"))]
    docs = table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    a = steps["language_id"](spark, docs, "").cache()
    assert sorted(r["doc_id"] for r in a.collect()) == [i for i, t in sorted(rows) if t is not None]
    b = steps["quality"](spark, a, "").cache()
    want = {r["doc_id"] for r in quality.line_quality(a).collect() if r["kept"]}
    assert {r["doc_id"] for r in b.collect()} == want and 52 not in want and 3 in want
    c = steps["near_dedup"](spark, b, "").cache()
    _, label = plain_components([(r["doc_id"], r["text"]) for r in b.collect()])
    assert sorted(r["doc_id"] for r in c.collect()) == sorted(set(label.values()))
    d = steps["mixing"](spark, c, "").cache()
    assert a.columns == b.columns == c.columns == d.columns == docs.columns
    e = steps["packing"](spark, d, "")
    total = sum(len(tokens(r["text"])) + 1 for r in d.collect())
    assert e.agg(F.sum("length")).first()[0] == total
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == total


def test_every_plain_character_is_split_as_the_library_does():
    texts = [f"{chr(i)}x{chr(i) * 3} a{chr(i)}'s" for i in range(1, 0x300)]
    assert [x.tolist() for x in word_bpe.IdCache(word_bpe.default_path()).encode(texts)] == [tokens(t) for t in texts]


def edited(words, changes, tag):
    words = list(words)
    for c in range(changes):
        words[5 + (c * 53) % (len(words) - 10)] = f"{tag}x{c}"
    return " ".join(words)


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_pipeline_drops_edited_copies_of_five_word_similarity(spark):
    rows, kept, similar = [], set(), []
    for i in range(60):
        base = [f"f{i}w{k}" for k in range(400)]
        copy = edited(base, 1 + i % 12, f"f{i}")
        similar.append(jaccard(" ".join(base), copy))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, copy)]
        kept |= {2 * i} if similar[-1] >= 0.8 else {2 * i, 2 * i + 1}
    assert sum(0.8 <= s < 0.9 for s in similar) >= 10 and sum(0.7 < s < 0.8 for s in similar) >= 10
    group = [f"g{k}" for k in range(300)]
    rows += [(1000 + i, edited(group, 2, f"g{i}")) for i in range(60)]  # all near each other
    docs = table(spark, rows)
    got = sorted(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect())
    assert got == sorted(kept | {1000})


def test_band_keys_find_nearly_all_pairs_at_the_bound():
    rng, missed = np.random.default_rng(5), 0
    for _ in range(400):
        both = rng.integers(0, 2**64, 400, dtype="u8")
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**64, 50, dtype="u8")])) for _ in "ab")  # similarity 0.8
        missed += not set(near_copies.band_keys(a)) & set(near_copies.band_keys(b))
    assert missed == 0


def test_near_copies_in_blocks_join_a_chain(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SIDE", 3)
    words = [f"c{k}" for k in range(700)]
    chain = [" ".join(words[5 * i : 5 * i + 200]) for i in range(60)]  # each near the next four, none near all
    docs = table(spark, [(i, t) for i, t in enumerate(chain)] + [(500, "apart from all of the others here")])
    assert sorted(r["doc_id"] for r in near_copies.representatives(docs).collect()) == [0, 500]


def test_token_counts_of_one_run_of_letters(spark):
    run = "acgt" * 50_000
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(table(spark, [(1, run), (2, run), (3, "short words")])).collect()}
    assert got == {1: len(tokens(run)), 2: len(tokens(run)), 3: len(tokens("short words"))} and got[1] > 65_535
    assert set(token_counts.frequent_pieces(table(spark, [(1, run), (2, run), (3, "short words")]), word_bpe.default_path())) == {"short", "words"}


def test_rows_without_an_id_or_with_one_id_are_kept(spark):
    texts = [" ".join(f"n{i}w{k}" for k in range(60)) for i in range(40)]
    rows = [(None, t) for t in texts] + [(None, texts[0]), (5, texts[1]), (7, "aa bb cc dd ee ff gg"), (7, "hh ii jj kk ll mm nn")]
    docs = table(spark, rows)
    want = sorted({t for _, t in rows})
    for result in (simhash.representatives(docs), corpus_pipeline.one_of_each(spark, docs, "")):
        got = result.select("doc_id", "text").collect()
        assert sorted(r["text"] for r in got) == want and (5, texts[1]) in {tuple(r) for r in got}
    many = spark.range(2000).selectExpr("cast(null as long) doc_id", "concat('t', id) text", "'en' lang", "if(id % 4 = 0, 'a', 'b') source", "3L n_chars")
    mixed = corpus_pipeline.mixed(spark, many, "")
    n = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert 500 < mixed.select("text").distinct().count() < 2000 and abs(n["a"] + n["b"] - 2000) < 200
    again = corpus_pipeline.mixed(spark, many.repartition(7), "")
    assert sorted(r["text"] for r in mixed.collect()) == sorted(r["text"] for r in again.collect())


def test_warm_token_cache_keeps_what_a_slice_needs():
    cache = word_bpe.IdCache(word_bpe.default_path(), entries=3)
    for text in ("alpha beta", "alpha gamma delta epsilon zeta", "beta alpha"):
        assert cache.encode([text])[0].tolist() == tokens(text)


def test_fingerprints_give_candidates_that_the_sets_decide(spark):
    """Candidates within two bits come from SimHash, before any MinHash key is read."""
    words = [f"s{k}" for k in range(900)]
    texts = [" ".join(words), " ".join(words[:-1] + ["other"]), " ".join(reversed(words))]
    prints = [simhash.majority(near_copies.shingle_set(t)) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 2
    keys = near_copies._by_fingerprint(near_copies._classes(table(spark, list(enumerate(texts))).selectExpr("doc_id AS row", "text")))
    a, b = (near_copies._class(near_copies.shingle_set(t)) for t in texts[:2])
    assert [tuple(r) for r in keys.collect()] == [(min(a, b), max(a, b))]
    links = near_copies.near_copies(table(spark, list(enumerate(texts))))[1]
    assert [(r["class"], r["root"]) for r in links.collect()] == [(max(a, b), min(a, b))]


def test_language_reads_texts_only(spark):
    """Texts do not come back from Python, nor does any other column go there."""
    docs = table(spark, [(i, f"word and word {i}") for i in range(40)])
    plan = language_id.recognised(docs, language_id.fit(docs, F.lit(True)))._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan
