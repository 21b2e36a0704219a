"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is the mean of the embeddings of its words and of their character n-grams, hashed into a fixed number of rows. Both
layers are trained by stochastic gradient descent in numpy on the driver, on a bounded sample of labelled texts (whole ones);
a fifth of the sample is kept out to fit a temperature and the confidence below which a prediction is rejected. For
prediction the two layers are one table of class scores per hashed row, and a worker keeps the sums of words it has met.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenseq.llm.common import texts_in_slices

#: Labelled texts per language that training takes about, languages at most, hashed rows, size of an embedding.
PER_LANGUAGE, MOST_LANGUAGES, ROWS, DIM = 400, 512, 1 << 15, 16
#: How far the odds of the rejection bound lie below those of the least sure right answers.
MARGIN = 4.0
#: Words a worker remembers.
CACHE_WORDS = 300_000
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def subwords(word: str) -> list[int]:
    """Hashed rows of a word and its 2- and 3-grams, with marks at both ends; none where it has no letter, as number signs."""
    if not word.isalpha() and not (word := "".join(filter(str.isalpha, word))):
        return []
    marked = f"<{word}>"
    grams = [marked] + [marked[i : i + 2] for i in range(len(marked) - 1)] + [marked[i : i + 3] for i in range(len(marked) - 2)]
    return [zlib.crc32(g.encode()) % ROWS for g in grams]


@dataclass
class Model:
    """``table`` has the class scores of each hashed row; ``least`` is the confidence below which a prediction is rejected."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(samples: list[tuple[np.ndarray, np.ndarray, str]], languages: list[str], epochs: int = 8, rate: float = 2.0, seed: int = 3) -> Model:
    """``samples`` has hashed rows, their counts and the language of each text."""
    rng = np.random.default_rng(seed)
    place = {name: i for i, name in enumerate(languages)}
    order = rng.permutation(len(samples))
    kept_out, used = order[: len(order) // 5], order[len(order) // 5 :]
    used = used if len(used) else order
    embed = rng.uniform(-1 / DIM, 1 / DIM, (ROWS, DIM))
    layer, bias = np.zeros((DIM, len(languages))), np.zeros(len(languages))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(used):
            rows, count, name = samples[i]
            share = count / count.sum()
            hidden = share @ embed[rows]
            wrong = softmax((hidden @ layer + bias)[None])[0]
            wrong[place[name]] -= 1
            back = layer @ wrong
            layer -= step * np.outer(hidden, wrong)
            bias -= 0.1 * step * wrong
            embed[rows] -= step * share[:, None] * back * len(rows) ** 0.5
    model = Model(languages, (embed @ layer).astype("f4"), bias)
    if len(kept_out):
        scores = np.array([(samples[i][1] / samples[i][1].sum()) @ model.table[samples[i][0]] + bias for i in kept_out])
        truth = np.array([place[samples[i][2]] for i in kept_out])
        grid = np.geomspace(0.5, 16, 21)
        loss = [-np.log(softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        sure = softmax(scores / model.temperature)
        right = sure.max(axis=1)[sure.argmax(axis=1) == truth]
        # below all but one right answer in a thousand, with a margin of MARGIN in the odds: a few texts do not show the rarest
        if len(right):
            odds = np.quantile(right, 0.001) / max(1 - np.quantile(right, 0.001), 1e-12) / MARGIN
            model.least = float(odds / (1 + odds))
    return model


def fit(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, seed: int = 3) -> Model | None:
    """A model from about ``per_language`` whole texts of each ``lang`` among the rows of ``learn``, or None without any.

    Counts of languages are over all rows; the ``MOST_LANGUAGES`` most frequent are learned. A text is taken where the hash of
    its id and text falls below its language's share, so rows without an id or with a repeated one are drawn each by their
    text; of rows that repeat both one is taken. Null and empty texts, texts without a letter and null languages are not
    learned from; an empty table gives None.
    """
    able = docs.select("doc_id", "text", "lang").where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != UNKNOWN))
    counts = {r.lang: r.n for r in able.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return None
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, counts_ = [], []
            for _, texts in texts_in_slices(batch):
                for text in texts:
                    seen: Counter[int] = Counter()
                    for word, n in Counter(WORD.findall(text.lower())).items():
                        for h in subwords(word):
                            seen[h] += n
                    rows.append(list(seen.keys()))
                    counts_.append(list(seen.values()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("lang"), pa.array(rows, pa.list_(pa.int32())), pa.array(counts_, pa.list_(pa.int64()))], ["key", "lang", "rows", "counts"])

    taken = able.where(draw < shares[F.col("lang")]).dropDuplicates(["doc_id", "lang", "text"]).select(F.xxhash64("doc_id", "text").alias("key"), "lang", "text")
    found = taken.mapInArrow(featurise, "key long, lang string, rows array<int>, counts array<long>").where("size(rows) > 0").collect()
    samples = [(np.array(r.rows), np.array(r.counts, dtype="f8"), r.lang) for r in sorted(found, key=lambda r: (r.key, r.lang))]
    languages = sorted({r.lang for r in found})
    return train(samples, languages, seed=seed) if samples else None


class Scorer:
    """Class scores of texts under a model, remembering words."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.stacked = np.zeros((0, len(self.model.languages) + 1))

    def _learn(self, words: set[str]) -> None:
        if len(self.place) + len(words) > CACHE_WORDS:
            self._clear()
        split = [subwords(word) for word in words]
        size = np.fromiter(map(len, split), dtype="i8", count=len(split))
        rows = self.model.table[np.fromiter(chain.from_iterable(split), dtype="i8", count=size.sum())].astype("f8")
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        sums = np.zeros((len(size), rows.shape[1]))
        if size.any():
            sums[size > 0] = np.add.reduceat(rows, (np.cumsum(size) - size)[size > 0])
        self.stacked = np.vstack([self.stacked, np.column_stack([sums, size])])

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(best class or -1, confidence)`` of each text."""
        words = [WORD.findall(t.lower()) for t in texts]
        needed = set().union(*words)
        if missing := needed.difference(self.place):
            if len(self.place) + len(missing) > CACHE_WORDS:
                self._clear()
                missing = needed
            self._learn(missing)
        out, sure = np.full(len(texts), -1), np.zeros(len(texts))
        for i, found in enumerate(words):
            if found:
                total = self.stacked[np.fromiter(map(self.place.__getitem__, found), dtype="i8", count=len(found))].sum(axis=0)
                if not total[-1]:
                    continue  # number signs alone
                p = softmax(((total[:-1] / total[-1] + self.model.bias) / self.model.temperature)[None])[0]
                out[i], sure[i] = int(p.argmax()), float(p.max())
        return out, sure


def _found(docs: DataFrame, model: Model | None) -> Column:
    """A struct ``lang_pred, score, rejected`` of each ``text``; no other column goes to Python, and no text comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: hashed rows times languages

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            best, sure = [], []
            for _, texts in texts_in_slices(pa.RecordBatch.from_arrays([batch], ["text"])):
                a, b = scorer.score(texts) if scorer else (np.full(len(texts), -1), np.zeros(len(texts)))
                best += a.tolist()
                sure += b.tolist()
            lang = [scorer.model.languages[i] if i >= 0 else UNKNOWN for i in best]
            out = [i < 0 or p < scorer.model.least for i, p in zip(best, sure, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(out, pa.bool_())], ["lang_pred", "score", "rejected"])

    return found(F.col("text"))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` and a struct ``_language``: ``lang_pred, score, rejected``; a column of that name is replaced.

    A null text or one without a letter is ``und`` with score 0 and is rejected, as is every text where nothing could be
    learned. Any other text gets a learned language; it is rejected where its calibrated probability is below the model's
    bound. Long texts are read whole; repeated rows each get a row; an empty table gives no rows.
    """
    docs = docs.drop("_language")
    return docs.select("*", _found(docs, model).alias("_language"))


def recognised(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns as they are, whatever their names."""
    return docs.where(~_found(docs, model)["rejected"])
