"""Phrase collocations by partitioned mining in two passes.

Pass one splits the rows into a few shards and mines each completely: every phrase of up to ``longest`` words is counted
inside its shard, and kept where it reaches the support lowered to the shard's share of all words. A phrase below its
lowered support in every shard is below the support overall, so the union of what the shards keep misses nothing. Support
is an absolute number, so more shards than ``support`` would lower it to one and prune nothing: shards stay few, and
many tasks mine one together. They do so on 64-bit hashes, where a clash can only add a candidate.

Pass two counts the candidates in all rows exactly, by their words. Which phrases are worth spelling out is read from a
filter of the candidates' hashes, whose size has a fixed bound; what it lets through by mistake is counted like the rest and
falls below the support. Scores, absorption and ranks are joins and aggregates of the counted phrases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenseq.llm.common import hot_lookup, shuffle_partitions, squeeze, squeeze_sorted, unsqueeze, unsqueeze_sorted, whole
from lumenseq.session import cut_lineage

SHARDS = 4
#: Filter: bits for a candidate, bits at most (32 MB), probes.
BITS_EACH, MOST_BITS, PROBES = 16, 1 << 28, 3
#: Tokens handled at once, words a task remembers, phrases it holds before it hands them on, bytes of a long text split at once.
CHUNK, CACHE_WORDS, HELD, SPAN = 200_000, 600_000, 3_000_000, 1_000_000
#: Phrase occurrences behind one bucket of hashes in one shard, about.
PER_BUCKET = 8_000_000
#: Bits of a word's number inside a phrase's; chunk and cache keep numbers below it.
WORD_BITS = 21
#: Partitions that rank one language's phrases first.
RANKERS = 32
UNKNOWN = "und"
#: Fixed value: a word; the characters that it excludes are the breaks and the blanks.
WORD = r"[^\x20\x09.,;:!?\x0A-\x0D]+"
BREAK, BLANK = 0, 1
#: Each byte of a text as it is read: breaks as line feeds, blanks as spaces, A-Z in lower case.
PLAIN = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256)).lower()
EDGE = re.compile(rb"[ \n]")


class _Ids(dict):
    """Numbers of one language's words, given out as they are asked for."""

    def __init__(self, lang: str, known: list[tuple[str, bytes]]):
        super().__init__({b"\n": BREAK, b"": BLANK})
        self.lang, self.known = lang, known

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.known)
        self.known.append((self.lang, word))
        return number


class Words:
    """Numbers of (language, word) pairs, from 2, their hashes, and the pairs again."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.known: list[tuple[str, bytes]] = [("", b"")] * 2
        self.by_lang: dict[str, _Ids] = {}
        self._hashes = np.zeros(2, "u8")

    def ids(self, lang: str, tokens: list[bytes]) -> np.ndarray:
        if lang not in self.by_lang:
            self.by_lang[lang] = _Ids(lang, self.known)
        return np.fromiter(map(self.by_lang[lang].__getitem__, tokens), dtype="i8", count=len(tokens))

    def hashes(self) -> np.ndarray:
        new = [xxhash.xxh3_64_intdigest(word, xxhash.xxh3_64_intdigest(lang.encode())) for lang, word in self.known[len(self._hashes) :]]
        self._hashes = np.concatenate([self._hashes, np.array(new, dtype="u8")])
        return self._hashes


def spans(data: bytes, size: int) -> Iterator[bytes]:
    """``data`` cut at blanks and breaks into spans of about ``size`` bytes; a longer word stays whole."""
    start = 0
    while start < len(data):
        cut = EDGE.search(data, start + size)
        end = cut.start() if cut else len(data)
        yield data[start:end]
        start = end


def chunks(batches: Iterator[pa.RecordBatch], words: Words, longest: int, chunk: int = CHUNK, span: int = SPAN) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(word numbers with breaks, repeated from before, shard)`` for runs of texts of about ``chunk`` tokens.

    A span of a long text starts with the last words of the span before it, marked as repeated, so no phrase is cut.
    ``words`` may be cleared between two runs.
    """
    ids, old, shards, held = [], [], [], 0

    def run() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found, repeated, shard = np.concatenate(ids), np.concatenate(old), np.concatenate(shards)
        real = found != BLANK
        ids.clear(), old.clear(), shards.clear()
        return found[real], repeated[real], shard[real]

    for batch in batches:
        for text, lang, shard in zip(batch.column("text").cast(pa.binary()), batch.column("lang").to_pylist(), batch.column("shard").to_pylist(), strict=True):
            tail: list[bytes] = []
            data = text.as_py().translate(PLAIN)
            for part in spans(data, span):
                tokens = tail + part.replace(b"\n", b" \n ").split(b" ")
                ids.append(words.ids(lang, [*tokens, b"\n"]))
                old.append(np.arange(len(tokens) + 1) < len(tail))
                shards.append(np.full(len(tokens) + 1, shard, "u1"))
                held += len(tokens) + 1
                if len(part) < len(data):
                    tail = [t for t in tokens[-span:] if t][1 - longest :]
                if held >= chunk:
                    yield run()
                    held = 0
    if ids:
        yield run()


def mix(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases from the hashes of all before the last word and of that word."""
    x = hashes * np.uint64(0x9E3779B97F4A7C15) + last
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def phrases(ids: np.ndarray, old: np.ndarray, hashes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(words, places of the last word, hashes)`` of the phrases inside the pieces, for 1 to ``longest`` words."""
    word, fresh, each = ids != BREAK, ~old, hashes[ids]
    inside, found = word, each
    for n in range(1, longest + 1):
        if n > 1:
            inside, found = inside[:-1] & word[n - 1 :], mix(found[:-1], each[n - 1 :])
        at = np.flatnonzero(inside & fresh[n - 1 :])
        yield n, at + (n - 1), found[at]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of hashes, numbered in their order."""
    return ((hashes >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype("i8")


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, "i8")
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


class Filter:
    """Bits of hashes, by bucket; ``has`` never misses one that was put in."""

    def __init__(self, buckets: int, bits: int, data: bytes | None = None):
        self.buckets, self.bits = buckets, bits
        self.data = np.frombuffer(data, "u1") if data is not None else None

    def places(self, hashes: np.ndarray, probe: int) -> np.ndarray:
        return ((hashes * np.uint64(0x9FB21C651E98DF25 + 2 * probe) >> np.uint64(24)) % np.uint64(self.bits)).astype("i8")

    def segment(self, hashes: np.ndarray) -> bytes:
        bits = np.zeros(self.bits, bool)
        for probe in range(PROBES):
            bits[self.places(hashes, probe)] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def has(self, hashes: np.ndarray) -> np.ndarray:
        start, out = bucket_of(hashes, self.buckets) * self.bits, np.ones(len(hashes), bool)
        for probe in range(PROBES):
            at = start + self.places(hashes, probe)
            out &= (self.data[at >> 3] >> (at & 7).astype("u1") & 1).astype(bool)
        return out


def mine(texts: DataFrame, supports: dict[int, int], buckets: int, longest: int, held_most: int = HELD) -> DataFrame:
    """``(bucket, n, keys)``: per shard and bucket, hashes of all phrases that reach the shard's support."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, keys, shards, held = Words(), [], [], 0

        def flush() -> pa.RecordBatch:
            every, where, rows = np.concatenate(keys), np.concatenate(shards), []
            for shard in np.unique(where):
                found, times = np.unique(every[where == shard], return_counts=True)
                bucket = bucket_of(found, buckets)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                for first, last in zip(cuts, [*cuts[1:], len(found)], strict=True):
                    rows.append((int(shard), int(bucket[first]), squeeze_sorted(found[first:last]), squeeze(times[first:last].astype("<u4"))))
            keys.clear(), shards.clear()
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "bucket", "keys", "counts"])

        for ids, old, shard in chunks(batches, words, longest):
            for _, at, found in phrases(ids, old, words.hashes(), longest):
                keys.append(found)
                shards.append(shard[at])
                held += len(at)
            if len(words.known) > CACHE_WORDS:
                words.clear()
            if held >= held_most:
                yield flush()
                held = 0
        if keys:
            yield flush()

    def frequent(group: pa.Table) -> pa.Table:
        keys = np.concatenate([unsqueeze_sorted(k.as_py()) for k in group.column("keys")])
        keys, times = counted(keys, np.concatenate([unsqueeze(c.as_py(), "<u4") for c in group.column("counts")]).astype("i8"))
        keys = keys[times >= supports[group.column("shard")[0].as_py()]]
        return pa.table({"bucket": pa.array([group.column("bucket")[0].as_py()], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "keys": pa.array([squeeze_sorted(keys)], pa.binary())})

    found = texts.mapInArrow(hashed, "shard int, bucket int, keys binary, counts binary")
    return found.groupBy("shard", "bucket").applyInArrow(frequent, "bucket int, n long, keys binary")


def candidate_filter(mined: DataFrame, buckets: int) -> Filter:
    """A filter of all candidates: the shards' hashes of a bucket united, its bits set by one task."""
    total = mined.agg(F.sum("n")).first()[0] or 0
    bits = -(-max(64, min(BITS_EACH * int(total) // buckets, MOST_BITS // buckets)) // 8) * 8
    made = Filter(buckets, bits)

    def segment(group: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate([unsqueeze_sorted(k.as_py()) for k in group.column("keys")]))
        return pa.table({"bucket": group.column("bucket").slice(0, 1), "bits": pa.array([made.segment(keys)], pa.binary())})

    rows = mined.where("n > 0").groupBy("bucket").applyInArrow(segment, "bucket int, bits binary").collect()  # MOST_BITS at most
    data = bytearray(buckets * bits // 8)
    for r in rows:
        data[r.bucket * bits // 8 : (r.bucket + 1) * bits // 8] = r.bits
    return Filter(buckets, bits, bytes(data))


def count_exactly(texts: DataFrame, wanted: Filter, longest: int, held_most: int = HELD) -> DataFrame:
    """``lang, phrase, words, f`` of all phrases that the filter lets through, counted over all rows."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)  # MOST_BITS at most
    mask = (1 << WORD_BITS) - 1

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, words = shared.value, Words()
        keys: dict[int, list[np.ndarray]] = {n: [] for n in range(1, longest + 1)}
        times: dict[int, list[np.ndarray]] = {n: [] for n in keys}
        held = 0

        def gather() -> int:
            for n in keys:
                if keys[n]:
                    k, t = counted(np.concatenate(keys[n]), np.concatenate(times[n]))
                    keys[n], times[n] = [k], [t]
            return sum(len(x) for n in keys for x in keys[n])

        def flush() -> pa.RecordBatch:
            gather()
            langs, texts, sizes, counts = [], [], [], []
            for n in keys:
                for k in keys[n]:
                    parts = [(k >> WORD_BITS * (n - 1 - i) & mask).tolist() for i in range(n)]
                    langs += [words.known[i][0] for i in parts[0]]
                    texts += [b" ".join([words.known[i][1] for i in row]).decode() for row in zip(*parts, strict=True)]
                    sizes += [n] * len(k)
                counts += times[n]
                keys[n], times[n] = [], []
            counts = np.concatenate(counts) if counts else np.zeros(0, "i8")
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), pa.array(counts, pa.int64())], ["lang", "phrase", "words", "f"])

        for ids, old, _ in chunks(batches, words, longest):
            for n, at, found in phrases(ids, old, words.hashes(), longest):
                at = at[wanted.has(found)]
                key = ids[at - (n - 1)]
                for back in range(n - 2, -1, -1):
                    key = key << WORD_BITS | ids[at - back]
                keys[n].append(key)
                times[n].append(np.ones(len(key), "i8"))
                held += len(key)
            if held >= held_most:
                held = gather()
            if held >= held_most // 2 or len(words.known) > CACHE_WORDS:
                yield flush()
                words.clear()
                held = 0
        yield flush()

    found = texts.mapInArrow(spell, "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, support: int = 10, longest: int = 3, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, words, f)`` of all phrases of 1 to ``longest`` words with ``f >= support``, and ``(lang, n)``."""
    if not 2 <= longest <= 63 // WORD_BITS:
        raise ValueError("longest must be 2 or 3")
    if not 1 <= shards <= 256:
        raise ValueError("shards must be 1 to 256")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), whole().alias("text"))
    texts = texts.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int"))
    words = cut_lineage(texts.groupBy("lang", "shard").agg(F.sum(F.regexp_count("text", F.lit(WORD)).cast("long")).alias("n")))
    sizes = {r.shard: r.n for r in words.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    total = sum(sizes.values())
    supports = {s: max(1, -(-support * n // max(total, 1))) for s, n in sizes.items()}
    buckets = max(-(-2 * shuffle_partitions(docs.sparkSession) // shards), -(-longest * total // (shards * PER_BUCKET)))
    mined = cut_lineage(mine(texts, supports, buckets, longest))
    exact = cut_lineage(count_exactly(texts, candidate_filter(mined, buckets), longest).where(F.col("f") >= support))
    return exact, words.groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0")


def scored(exact: DataFrame, longest: int, total_words: int) -> DataFrame:
    """Candidates with ``a, l, r, score`` of their lowest cut (lengths of the first part: the smallest of equal ones)."""

    def part(first: int, size: Column | int) -> Column:
        return F.array_join(F.slice(F.split("phrase", " "), first, size), " ")

    cuts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), (part(1, k) if side == "l" else part(k + 1, F.col("words"))).alias("part")) for k in range(1, longest) for side in "lr"])
    candidates = exact.where("words > 1").withColumnRenamed("f", "a")
    parts = candidates.withColumn("cut", F.explode(F.filter(cuts, lambda c: c["k"] < F.col("words")))).select("lang", "phrase", "words", "a", "cut.*")
    known = exact.select("lang", F.col("phrase").alias("part"), "f")
    hot = (F.col("f") * 4096 >= total_words) & (F.octet_length("part") <= 256)  # at most 4096 of each length in words
    found = hot_lookup(parts, known, ["lang", "part"], hot)
    sums = found.groupBy("lang", "phrase", "words", "a").agg(
        *[F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}") for k in range(1, longest) for side in "lr"])
    wide = lambda c: f"CAST({c} AS DECIMAL(20, 0))"
    cut = [F.when(F.col("words") > k, F.struct(F.expr(f"(1000000 * {wide('a')} * {wide('a')}) div ({wide(f'l{k}')} * {wide(f'r{k}')})").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]
    return sums.withColumn("best", F.array_min(F.array(*cut))).select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def unabsorbed(candidates: DataFrame, longest: int, percent: int = 50) -> DataFrame:
    """Candidates that no longer one holds with at least ``percent`` per cent of their occurrences."""
    words = F.split("phrase", " ")
    inner = F.array(*[F.array_join(F.slice(words, first + 1, size), " ") for size in range(2, longest) for first in range(longest - size + 1)])
    room = F.array(*[(F.lit(first + size) <= F.col("words")) & (F.lit(size) < F.col("words")) for size in range(2, longest) for first in range(longest - size + 1)])
    if longest == 2:
        return candidates
    held = F.filter(F.arrays_zip(inner.alias("p"), room.alias("fits")), lambda x: x["fits"])
    longer = candidates.where("words > 2").select("lang", F.explode(held).alias("x"), "a").groupBy("lang", F.col("x.p").alias("phrase")).agg(F.max("a").alias("longer"))
    return candidates.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent)).drop("longer")


def collocations(docs: DataFrame, support: int = 10, longest: int = 3, top: int = 2000, percent: int = 50, shards: int = SHARDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` collocations of each language.

    A null text counts as empty and a null ``lang`` as ``und``; repeated rows count each; a very long text is read in spans
    that share words; ties are ordered by ``a``, then by phrase; an empty table gives no rows; other columns are not read.
    ``a`` must stay below 10^16 for exact scores.
    """
    exact, n = frequent_phrases(docs, support, longest, shards)
    total = n.agg(F.sum("n")).first()[0] or 0
    kept = unabsorbed(cut_lineage(scored(exact, longest, int(total))), longest, percent)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKERS)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(support: int = 10, top: int = 2000, percent: int = 50) -> str:
    """The same in DuckDB's SQL, for phrases of two and three words."""
    return rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
      FROM p, (VALUES (1), (2), (3)) AS size(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {support}),
q AS MATERIALIZED (SELECT lang, k, phrase, a, cut, array_to_string(list_slice(w, 1, cut), ' ') AS lp, array_to_string(list_slice(w, cut + 1, k), ' ') AS rp
      FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (SELECT q.lang, q.k, q.phrase, q.a, cut, l.f AS l, r.f AS r, 1000000 * q.a * q.a // (l.f * r.f) AS score
      FROM q JOIN f AS l ON l.lang = q.lang AND l.phrase = q.lp JOIN f AS r ON r.lang = q.lang AND r.phrase = q.rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
x AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN x USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {percent} * a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) JOIN n USING (lang) WHERE rank <= {top}"""
