"""Byte classifier, vector codes and phrases against plain versions."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenseq.llm import byte_cnn, phrases, vector_codes
from lumenseq.llm.common import id_remainder

DOCS = "doc_id long, text string, lang string, words string, f long, shard string, phrase string, score string, predicted string, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, "x", "x", "x", "x", "x") for i, t, lang in rows], DOCS).repartition(3)


# --- phrases


def plain_phrases(rows, support, longest, top, percent):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        piece_list = [[]]
        for c in lowered:
            if c in ".,;:!?\n\x0b\x0c\r":
                piece_list.append([])
            else:
                piece_list[-1].append(c)
        for piece in piece_list:
            words = [w for w in "".join(piece).replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= support}
    out = []
    for (lang, words), a in found.items():
        if any(g == lang and len(other) > len(words) and 100 * b >= percent * a and any(other[i : i + len(words)] == words for i in range(len(other)))
               for (g, other), b in found.items()):
            continue
        cuts = [(1000000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        rows_ = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(rows_[:top])]
    return sorted(ranked)


def prose(seed, n, words):
    rng = random.Random(seed)
    return "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\r\n"]) for _ in range(n))


PROSE = [
    (1, prose(1, 900, ["The", "the", "État", "no\xa0break", "x", "a\x1cb", "é"]), "fr"), (2, prose(2, 700, ["one", "two", "three"]), None),
    (2, prose(2, 700, ["one", "two", "three"]), None), (None, prose(3, 400, ["aa", "b", "c"]), "und"), (3, None, "fr"), (4, "", "en"), (5, " \t.,;", "en"),
    (6, "z z z z z z z z z z z z z z z z", "en"), (7, "日本 語 " * 40, "ja"), (8, "only once", "en"),
]


@pytest.mark.parametrize("support, top", [(10, 2000), (3, 5)])
def test_phrases(spark, support, top):
    got = sorted(tuple(r) for r in phrases.collocations(table(spark, PROSE), support=support, top=top).collect())
    want = plain_phrases([(t, lang) for _, t, lang in PROSE], support, 3, top, 50)
    assert want and got == want


def test_phrases_of_two_words(spark):
    got = sorted(tuple(r) for r in phrases.collocations(table(spark, PROSE), support=5, longest=2).collect())
    assert got == plain_phrases([(t, lang) for _, t, lang in PROSE], 5, 2, 2000, 50)


def test_phrases_small_buffers(spark, monkeypatch):
    """Spans, chunks and buffers far below the texts: phrases that cross them are counted once."""
    texts = table(spark, PROSE).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 2).cast("int").alias("shard")).na.fill({"shard": 0})
    every = phrases.Filter(1, 64, b"\xff" * 8)
    whole_ = {tuple(r) for r in phrases.count_exactly(texts, every, 3).collect()}
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"text": t or "", "lang": lang or "und", "shard": 0} for _, t, lang in PROSE])
    words, f = phrases.Words(), Counter()
    for ids, old, _ in phrases.chunks(iter([batch]), words, 3, chunk=50, span=37):
        for n, at, _ in phrases.phrases(ids, old, words.hashes(), 3):
            f.update((words.known[ids[i]][0], b" ".join(words.known[j][1] for j in ids[i - n + 1 : i + 1]).decode(), n) for i in at)
        words.clear()
    assert whole_ == {(*key, times) for key, times in f.items()}
    tiny = {tuple(r) for r in phrases.count_exactly(texts, every, 3, held_most=5).collect()}
    assert tiny == whole_


def test_lowered_support_misses_nothing(spark):
    texts = table(spark, PROSE).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(3)).cast("int"))
    n = {r.shard: r.n for r in texts.groupBy("shard").agg(F.sum(F.regexp_count("text", F.lit(phrases.WORD))).alias("n")).collect()}
    mined = phrases.mine(texts, {s: -(-10 * x // sum(n.values())) for s, x in n.items()}, 5, 3, held_most=50)
    wanted = phrases.candidate_filter(mined, 5)
    found = {(r.lang, r.phrase): r.f for r in phrases.count_exactly(texts, wanted, 3).collect()}
    f = {(lang or "und", p): a for lang, _, p, a, *_ in plain_phrases([(t, g) for _, t, g in PROSE], 10, 3, 2000, 10**9)}
    assert f and all(found[key] == a for key, a in f.items())


def test_phrases_big_counts(spark):
    """Products beyond 64 bits are exact."""
    a, l, r = 3 * 10**12 + 1, 4 * 10**12 + 3, 5 * 10**12 + 7
    exact = spark.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, l), ("en", "y", 1, r)], "lang string, phrase string, words int, f long")
    row = phrases.scored(exact, 3, l + r).first()
    assert (row.a, row.l, row.r, row.score) == (a, l, r, 1000000 * a * a // (l * r))


# --- vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(kept[0][1])
    whole_ = [[math.floor(4096 * x) if abs(x) < 2**900 else int(x) * 4096 for x in v] for _, v, _ in kept]
    cuts = [p * length // parts for p in range(parts + 1)]
    books = [[w[a:b] for w in [w for w in whole_ if len(w) == length][:entries]] for a, b in zip(cuts, cuts[1:])]

    def assign():
        out = []
        for w in whole_:
            if len(w) != length:
                out.append(None)
                continue
            out.append([min((sum((x - y) ** 2 for x, y in zip(w[a:b], e)), k) for k, e in enumerate(book)) for book, a, b in zip(books, cuts, cuts[1:])])
        return out

    for _ in range(rounds):
        found = assign()
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            for k in range(len(books[p])):
                mine = [w[a:b] for w, f in zip(whole_, found) if f and f[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = assign()
    error = [f and sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, g), e in zip(kept, error):
        if e is not None:
            total[g] = total.get(g, 0) + e
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    return sorted(((i, f and "".join(f"{k:02x}" for _, k in f), fits(e), fits(total.get(g)), sha) for (i, _, g), f, e in zip(kept, found, error)), key=str)


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, g, "x", 7, "x") for i, v, g in rows], f"vec_id long, embedding array<{kind}>, label int, code string, error long, vector string").repartition(3)


def random_vectors(n, length, seed=1):
    rng = np.random.default_rng(seed)
    return [(i * 3, np.round(rng.normal(0, 0.3, length), 2).astype("f4").tolist(), int(i % 3) if i % 5 else None) for i in range(n)]


@pytest.mark.parametrize("length, n", [(16, 120), (13, 60), (3, 30), (64, 9)])
def test_vector_codes(spark, length, n):
    odd = [(500, None, 1), (501, [float("nan")] * length, 1), (502, [None] * length, 1), (503, [float("inf")] * length, 2), (504, [0.0] * (length + 1), 2), (505, [], 2)]
    rows = random_vectors(n, length) + odd + random_vectors(4, length) + [(None, [0.25] * length, None)]
    got = sorted(map(tuple, vector_codes.vector_codes(vectors(spark, rows)).collect()), key=str)
    assert got == plain_codes(rows)


def test_vector_codes_huge_components(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([1e300, -1e300, 1e9, 3.7, -2.2, 1e20]) for _ in range(8)], i % 2) for i in range(40)]
    got = sorted(map(tuple, vector_codes.vector_codes(vectors(spark, rows, "double")).collect()), key=str)
    assert got == plain_codes(rows)


def test_no_vectors(spark):
    none = vectors(spark, [(1, None, 1)])
    assert vector_codes.vector_codes(none).count() == 0
    assert vector_codes.vector_codes(none.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [1, 3, 1000])
def test_nearest_entries_with_ties(spread):
    rng = np.random.default_rng(5)
    for entries in (1, 2, 5, 16, 200):
        points = rng.integers(-spread, spread + 1, (entries, 4))
        rows = rng.integers(-spread, spread + 1, (300, 4))
        tree = vector_codes.build(points)
        number, least = vector_codes.nearest_entries(tree, points, rows)
        every = ((rows[:, None] - points[None]) ** 2).sum(axis=2)
        assert (number == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()


# --- byte classifier


def noisy(seed):
    rng = random.Random(seed)
    clean = seed % 3 > 0
    words = [rng.choice(["stone", "river", "cloud", "meadow", "the", "and", "über"]) + ("" if clean else rng.choice(["###", "%%%", "&&&"])) for _ in range(rng.randint(20, 200))]
    return " ".join(words), int(clean)


def test_byte_cnn(spark):
    made = [(i, *noisy(i)) for i in range(400)]
    docs = table(spark, [(i, t, "en") for i, t, _ in made] + [(None, "x", "en"), (None, None, "en"), (1000, "", "en"), (7, "second text of an id", "en"), (1001, "### %%% " * 200_000, "en")])
    labels = spark.createDataFrame([(i, q, "x") for i, _, q in made] + [(None, 1, "x"), (1000, None, "x"), (3, 1 - made[3][2], "x")], "doc_id long, quality int, text string")
    learn = id_remainder(F.col("doc_id"), 5) != 0
    samples, share = byte_cnn.labelled(docs, labels, learn)
    assert len(samples) == len({i for i, *_ in made if i != 3 and i in {r.doc_id for r in labels.where(learn).collect()}}) and 0.6 < share < 0.7
    net = byte_cnn.fit(docs, labels, learn)
    rows = byte_cnn.classify(docs, net).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    truth = {i: q for i, _, q in made}
    out = {r.doc_id for r in docs.where(~learn).collect()}
    held = [r for r in rows if r.doc_id in out and r.doc_id in truth and r.doc_id != 7]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert next(r for r in rows if r.doc_id == 1001).predicted == 0
    again = byte_cnn.labelled(docs.repartition(2), labels.repartition(5), learn)
    assert again == (samples, share)


def test_byte_cnn_whole_text_and_slices(monkeypatch):
    """Responses computed piece by piece equal a plain loop over all places, chunks and filters."""
    net = byte_cnn.new_net(3)
    net.bias += 0.1
    texts = [b"", b"a", bytes(range(1, 256)) * 9, b"xyz" * 3000]
    monkeypatch.setattr(byte_cnn, "HELD_PLACES", byte_cnn.BLOCK)
    table_ = net.table()
    got = byte_cnn.logits(net, table_, texts)
    room, size, step = byte_cnn.BLOCK * byte_cnn.STRIDE, byte_cnn.BLOCKS, byte_cnn.STEP
    for text, want in zip(texts, got):
        blocks = max(1, -(-len(text) // room))
        padded = text + b"\0" * (blocks * room - len(text))
        at = texts.index(text)
        after = (texts[at + 1][: byte_cnn.WIDTH] if at + 1 < len(texts) else b"").ljust(byte_cnn.WIDTH, b"\0")
        data = padded + after
        found = np.array([sum(table_[w, data[i + w]] for w in range(byte_cnn.WIDTH)) for i in range(0, blocks * room, byte_cnn.STRIDE)])
        starts = range(0, max(blocks - size + step - 1, 0) // step * step + 1, step) if blocks > size else [0]
        chunks = np.array([np.maximum(found[s * byte_cnn.BLOCK : min(s + size, blocks) * byte_cnn.BLOCK].max(axis=0) + net.bias, 0) for s in starts])
        plain = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)]) @ net.out + net.shift[0]
        assert abs(plain - want) < 1e-4


def test_byte_cnn_gradients():
    net = byte_cnn.new_net(4)
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(0, 256, n, dtype="u1")) for n in (5, 300, 1500)]
    truth = np.array([1.0, 0.0, 1.0])

    def loss():
        docs = byte_cnn.logits(net, np.einsum("bd,wdf->wbf", net.vectors, net.filters), texts)
        return -np.mean(truth * np.log(byte_cnn.sigmoid(docs)) + (1 - truth) * np.log(1 - byte_cnn.sigmoid(docs)))

    for w, g in zip(net.weights(), byte_cnn.gradients(net, texts, truth)):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        before, kept = loss(), w[at]
        w[at] = kept + 1e-3
        moved = loss()
        w[at] = kept
        assert abs((moved - before) / 1e-3 - g[at]) < 0.05 * abs(g[at]) + 1e-4


def test_byte_cnn_without_labels(spark):
    docs = table(spark, [(1, "a", "en"), (2, None, "en")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert byte_cnn.fit(docs, none, F.lit(True)) is None
    assert [(r.score, r.predicted) for r in byte_cnn.classify(docs, None).collect()] == [(0.5, 1)] * 2
    assert byte_cnn.classify(docs.limit(0), None).count() == 0
