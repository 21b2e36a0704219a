"""Bigram language model as a weighted backoff automaton, learned from and applied to a whole corpus.

States are the root, the start of a text and one for each known token. A state's arcs are the bigrams seen in training; its
failure arc leads to the root, whose arcs are all tokens. With ``mu`` as the weight of the lower order,

    p(w | s) = (c(s w) + mu p(w)) / (c(s) + mu),   p(w) = (c(w) + 1) / (N + V + 1),

so an arc seen in training weighs log10 p(w | s), a failure arc log10(mu / (c(s) + mu)) and a root arc log10 p(w); every
state's arcs sum to one. One walk from left to right carries the state and adds up the weights.

The table of n-grams grows with the corpus, so no task holds it and nothing of it is broadcast or collected. Texts are dealt
into buckets of bounded size. A bucket asks for its own distinct n-grams, as sorted compressed blocks, one for each range of
the hashed keys; a range adds up what all buckets counted in training texts and answers each bucket with totals in the order
asked; the bucket then builds its part of the automaton and walks its texts. A frequent word is one key per bucket, so no
range is hot. n-grams are told apart by 63-bit hashes.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenseq.llm.common import bucket_count, hash_bucket, pack_rows, shared_path, squeeze, squeeze_sorted, unpack_rows, unsqueeze, unsqueeze_sorted, whole

#: Bytes of text in a bucket, and bytes of all text for each range of keys. On larger executors larger values make fewer, longer blocks.
BUCKET_BYTES, RANGE_BYTES = 12_000_000, 16_000_000
_END, _START = b"", np.uint64(0x5851F42D4C957F2C)


def _pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = before * np.uint64(0x9E3779B97F4A7C15) + word
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) | np.uint64(1)


@dataclass
class Grams:
    """Tokens of a bucket's texts and its distinct n-grams: words first, then bigrams."""

    token: np.ndarray  # word number of each token, text after text
    bigram: np.ndarray  # bigram number of each token
    first: np.ndarray  # where each text starts, and the end
    keys: np.ndarray  # hashed keys of words (even) and bigrams (odd)
    n_words: int
    order: np.ndarray  # sorts the keys

    def counts(self, train: np.ndarray) -> np.ndarray:
        """Occurrences of each key in the texts marked in ``train``."""
        use = np.repeat(train, np.diff(self.first))
        return np.concatenate([
            np.bincount(self.token[use], minlength=self.n_words),
            np.bincount(self.bigram[use], minlength=len(self.keys) - self.n_words),
        ])


def grams(texts: list[str]) -> Grams:
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    number[_END]
    parts, first = [], [0]
    for text in texts:
        words = text.encode().lower().split()  # bytes: A-Z alone is lowered, ASCII white space alone divides
        words.append(_END)
        parts.append(np.fromiter(map(number.__getitem__, words), dtype="i4", count=len(words)))
        first.append(first[-1] + len(words))
    token = np.concatenate(parts) if parts else np.zeros(0, "i4")
    words = np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in number), dtype="u8", count=len(number)) & ~np.uint64(1)
    before = np.empty(len(token), "u8")
    before[1:] = words[token[:-1]]
    before[first[:-1]] = _START
    pairs, bigram = np.unique(_pair_keys(before, words[token]), return_inverse=True)
    keys = np.concatenate([words, pairs])
    return Grams(token, bigram, np.array(first), keys, len(words), np.argsort(keys, kind="stable"))


def walk(g: Grams, total: np.ndarray, n: int, v: int, mu: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(n_known, base, score)`` of each text; texts are walked side by side, one token of each at a step."""
    seen, arcs = total[: g.n_words], total[g.n_words :]
    p_word = (seen + 1.0) / (n + v + 1.0)
    root = np.log10(p_word)
    fail = np.log10(mu / (seen + mu))  # by state; an unknown word leads to the root, where c = 0 and failing costs nothing
    size = np.diff(g.first)
    turn = np.argsort(-size, kind="stable")
    start, size = g.first[:-1][turn], size[turn]
    state_count = np.full(len(turn), float(seen[0]))  # the start has as many uses as texts have ends
    state_fail = np.full(len(turn), fail[0])
    score = np.zeros(len(turn))
    active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
    for step, k in enumerate(active):
        at = start[:k] + step
        word, arc = g.token[at], arcs[g.bigram[at]]
        taken = np.log10((arc + mu * p_word[word]) / (state_count[:k] + mu))
        score[:k] += np.where(arc > 0, taken, state_fail[:k] + root[word])
        state_count[:k], state_fail[:k] = seen[word], fail[word]
    out = np.empty(len(turn))
    out[turn] = score
    cut = g.first[:-1]
    return np.add.reduceat((seen > 0)[g.token].astype("i8"), cut), np.add.reduceat(root[g.token], cut), out


def lm_scores(docs: DataFrame, held_out: Column, mu: float = 30.0, bucket_bytes: int = BUCKET_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    ``held_out`` marks the texts that are scored and not learned from. A null text is empty and has the end token alone;
    repeated rows count and are scored each; one text longer than a bucket makes a larger bucket; an empty table gives no
    rows; other columns are not read.
    """
    spark = docs.sparkSession
    buckets = bucket_count(docs, bucket_bytes)
    ranges = max(buckets * bucket_bytes // range_bytes, 1)
    edges = np.array([i * 2**64 // ranges for i in range(1, ranges)], dtype="u8")
    packed = pack_rows(docs.select(hash_bucket(buckets, "doc_id", "text").alias("bucket"), "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), whole().alias("text")))

    def ask(group: pa.Table) -> pa.Table:
        rows = unpack_rows(group.column("rows"))
        g = grams(rows.column("text").to_pylist())
        count = g.counts(~rows.column("held_out").to_numpy())[g.order]
        keys = g.keys[g.order]
        cuts = [0, *np.searchsorted(keys, edges), len(keys)]
        spans = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        return pa.table({
            "span": pa.array([i for i, *_ in spans], pa.int32()),
            "bucket": pa.array([group.column("bucket")[0].as_py()] * len(spans), pa.int32()),
            "keys": pa.array([squeeze_sorted(keys[a:b]) for _, a, b in spans], pa.binary()),
            "counts": pa.array([squeeze(count[a:b].astype("<u4")) for _, a, b in spans], pa.binary()),
        })

    def add_up(group: pa.Table) -> pa.Table:
        keys = [unsqueeze_sorted(k.as_py()) for k in group.column("keys")]
        count = np.concatenate([unsqueeze(c.as_py(), "<u4") for c in group.column("counts")])
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, weights=count).astype("<i8")  # exact below 2**53
        word = (distinct & np.uint64(1)) == 0
        answers = np.split(total[where], np.cumsum([len(k) for k in keys])[:-1])
        n = len(answers)
        return pa.table({
            "bucket": group.column("bucket"), "span": group.column("span"),
            "totals": pa.array([squeeze(a) for a in answers], pa.binary()),
            "train_tokens": pa.array([int(total[word].sum())] + [0] * (n - 1), pa.int64()),
            "known_words": pa.array([int(np.count_nonzero(total[word]))] + [0] * (n - 1), pa.int64()),
        })

    answers = (
        packed.groupBy("bucket").applyInArrow(ask, "span int, bucket int, keys binary, counts binary")
        .groupBy("span").applyInArrow(add_up, "bucket int, span int, totals binary, train_tokens long, known_words long")
    )
    path = shared_path(spark, "lm-totals")
    answers.write.parquet(path)
    answers = spark.read.parquet(path)
    sums = answers.agg(F.sum("train_tokens"), F.sum("known_words")).first()
    n, v = int(sums[0] or 0), int(sums[1] or 0)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def score(group: pa.Table, replies: pa.Table) -> pa.Table:
        rows = unpack_rows(group.column("rows"))
        g = grams(rows.column("text").to_pylist())
        total = np.empty(len(g.keys), "i8")
        total[g.order] = np.concatenate([unsqueeze(x.as_py(), "<i8") for x in replies.sort_by("span").column("totals")])
        known, base, found = walk(g, total, n, v, mu)
        return pa.table({
            "doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "n_tokens": pa.array(np.diff(g.first), pa.int64()),
            "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(np.full(len(known), n), pa.int64()),
            "base_score": pa.array(base), "score": pa.array(found),
        })

    return packed.groupBy("bucket").cogroup(answers.select("bucket", "span", "totals").groupBy("bucket")).applyInArrow(
        score, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
