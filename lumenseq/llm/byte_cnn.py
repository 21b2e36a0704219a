"""Quality classifier: a convolutional network over bytes, in numpy.

Each byte has a learned vector, and learned filters slide over the bytes' vectors. The responses of a filter are max-pooled
over overlapping chunks that cover the whole text; the mean and the maximum of a chunk's pooled responses over all chunks
make up the document, from which one layer gives one probability. Training is mini-batch Adam on the driver over a bounded
sample of labelled texts, whole ones; a fifth of the sample is kept out to calibrate the probability. For prediction the
byte vectors and the filters are one table of responses per place in the filter and byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenseq.llm.common import texts_in_slices, whole

#: Labelled texts of each class that training takes at most, and the bytes up to which a text may be drawn for it.
PER_CLASS, TRAIN_BYTES = 1500, 65_536
#: Sizes: byte vectors, filters, bytes a filter sees, bytes between two places of a filter.
DIM, FILTERS, WIDTH, STRIDE = 8, 24, 8, 2
#: A chunk is so many blocks of so many places; chunks start every ``STEP`` blocks and overlap by the rest.
BLOCK, BLOCKS, STEP = 64, 4, 2
#: Places whose responses are held at once.
HELD_PLACES = 128 * BLOCK
THRESHOLD = 0.3


@dataclass
class Net:
    """``vectors`` of bytes, ``filters`` by place, byte vector and filter, ``bias`` of filters, ``out`` and ``shift`` of the last layer.

    The probability is the sigmoid of ``slope * logit + offset``.
    """

    vectors: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def weights(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.bias, self.out, self.shift]

    def table(self) -> np.ndarray:
        """Response of each filter to each byte at each of its places."""
        return np.einsum("bd,wdf->wbf", self.vectors, self.filters).astype("f4")


def new_net(seed: int) -> Net:
    rng = np.random.default_rng(seed)
    return Net(rng.normal(0, 0.5, (256, DIM)), rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH, DIM, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.05, 2 * FILTERS), np.zeros(1))


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each padded with zeros to whole blocks and followed by a filter's width; blocks of each text."""
    room = BLOCK * STRIDE
    blocks = np.array([max(1, -(-len(t) // room)) for t in texts], dtype="i8")
    data = np.zeros(int(blocks.sum()) * room + WIDTH, "u1")
    start = 0
    for text, n in zip(texts, blocks.tolist(), strict=True):
        data[start : start + len(text)] = np.frombuffer(text, "u1")
        start += n * room
    return data, blocks


def responses(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """``(place, filter)``, a place every ``STRIDE`` bytes."""
    places = (len(data) - WIDTH) // STRIDE
    total = np.zeros((places, FILTERS), "f4")
    for w in range(WIDTH):
        total += table[w].take(data[w : w + places * STRIDE : STRIDE], axis=0)
    return total


def block_maxima(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Largest response of each filter in each block."""
    room, held = BLOCK * STRIDE, HELD_PLACES * STRIDE
    parts = [responses(table, data[at : at + held + WIDTH]).reshape(-1, BLOCK, FILTERS).max(axis=1) for at in range(0, len(data) // room * room, held)]
    return np.concatenate(parts)


def chunks_of(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first block, block after the last, chunks of each text)`` of chunks that start every ``STEP`` blocks inside a text."""
    number = np.maximum(1, -(-(blocks - BLOCKS) // STEP) + 1)
    ends = np.cumsum(blocks)
    text = np.repeat(np.arange(len(blocks)), number)
    within = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    first = (ends - blocks)[text] + within * STEP
    return first, np.minimum(first + BLOCKS, ends[text]), number


def pooled(by_block: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Responses at their largest in each chunk, the block where that is, and the chunks of each text."""
    first, after, number = chunks_of(blocks)
    best, where = by_block[first].copy(), np.repeat(first[:, None], FILTERS, axis=1)
    for k in range(1, BLOCKS):
        at = np.minimum(first + k, after - 1)
        better = by_block[at] > best
        best[better] = by_block[at][better]
        where[better] = np.broadcast_to(at[:, None], where.shape)[better]
    return best, where, number


def documents(chunks: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Mean and maximum over the chunks of each text."""
    start = np.cumsum(number) - number
    return np.hstack([np.add.reduceat(chunks, start) / number[:, None], np.maximum.reduceat(chunks, start)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def logits(net: Net, table: np.ndarray, texts: list[bytes]) -> np.ndarray:
    data, blocks = lay_out(texts)
    best, _, number = pooled(block_maxima(table, data), blocks)
    return documents(np.maximum(best + net.bias, 0), number) @ net.out + net.shift[0]


def gradients(net: Net, texts: list[bytes], truth: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss, by weight."""
    data, blocks = lay_out(texts)
    found = responses(net.table(), data).reshape(-1, BLOCK, FILTERS)
    inner = found.argmax(axis=1)
    best, where, number = pooled(found.max(axis=1), blocks)
    active = np.maximum(best + net.bias, 0)
    docs = documents(active, number)
    wrong = (sigmoid(docs @ net.out + net.shift[0]) - truth) / len(texts)
    text = np.repeat(np.arange(len(texts)), number)
    back = wrong[text, None] * net.out[None, :FILTERS] / number[text, None]
    top = active == docs[text, FILTERS:]
    start = np.cumsum(number) - number
    back += wrong[text, None] * net.out[None, FILTERS:] * top / np.add.reduceat(top, start)[text]
    back *= active > 0
    rows, cols = np.nonzero(back)
    amount = back[rows, cols]
    block = where[rows, cols]
    first = (block * BLOCK + inner[block, cols]) * STRIDE
    by_byte = np.zeros((WIDTH, 256, FILTERS))
    for w in range(WIDTH):
        np.add.at(by_byte[w], (data[first + w], cols), amount)
    return [np.einsum("wbf,wdf->bd", by_byte, net.filters), np.einsum("wbf,bd->wdf", by_byte, net.vectors), back.sum(axis=0), wrong @ docs, np.array([wrong.sum()])]


def train(samples: list[tuple[bytes, int]], share: float, epochs: int = 12, batch: int = 16, rate: float = 4e-3, decay: float = 1e-4, seed: int = 11) -> Net:
    """``samples`` has texts with labels, about as many of each; ``share`` is the share of label 1 among all labelled rows."""
    rng = np.random.default_rng(seed)
    net = new_net(seed)
    order = rng.permutation(len(samples))
    out, used = order[: len(order) // 5], order[len(order) // 5 :]
    means, squares = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    steps, step = epochs * -(-len(used) // batch), 0
    for _ in range(epochs):
        shuffled = rng.permutation(used)
        for at in range(0, len(shuffled), batch):
            part = [samples[i] for i in shuffled[at : at + batch]]
            step += 1
            now = rate * (1 - (step - 1) / steps)
            for w, g, m, v in zip(net.weights(), gradients(net, [t for t, _ in part], np.array([y for _, y in part], "f8")), means, squares, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= now * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + decay * w)
    calibrate(net, [samples[i] for i in (out if len(out) else order)], share)
    return net


def calibrate(net: Net, samples: list[tuple[bytes, int]], share: float) -> None:
    """Slope and offset of the logit by Newton steps on ``samples``, each class weighted to its share of all labelled rows."""
    truth = np.array([y for _, y in samples], "f8")
    found = logits(net, net.table(), [t for t, _ in samples])
    ones = truth.sum()
    weight = np.where(truth > 0, share / max(ones, 1), (1 - share) / max(len(truth) - ones, 1))
    x, line = np.column_stack([found, np.ones(len(found))]), np.array([1.0, 0.0])
    smooth = np.where(truth > 0, (ones + 1) / (ones + 2), 1 / (len(truth) - ones + 2))  # keeps the slope finite
    for _ in range(50):
        p = sigmoid(x @ line)
        bend = x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(bend, x.T @ (weight * (p - smooth)))
        line -= step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))
    if line[0] > 0:
        net.slope, net.offset = float(line[0]), float(line[1])


def labelled(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS, seed: int = 11) -> tuple[list[tuple[bytes, int]], float]:
    """A sample of at most ``per_class`` whole texts of either quality, drawn by a hash of the id, and the share of quality 1.

    ``learn`` speaks of ``doc_id`` and says which labels may be used. Ids with both labels are left out. Of an id with several
    texts the smallest is taken, and none above ``TRAIN_BYTES`` bytes, so what comes to the driver is bounded.
    """
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    known = known.where("quality = most").select("doc_id", "quality")
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return [], 0.0
    drawn = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(per_class) for q in (0, 1)]
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))  # two per_class rows at most
    texts = docs.select("doc_id", whole().alias("text")).where(F.octet_length("text") <= TRAIN_BYTES).join(ids, "doc_id")
    rows = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    return [(r.text.encode(), r.quality) for r in sorted(rows, key=lambda r: r.doc_id)], counts[1] / sum(counts.values())


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS, seed: int = 11) -> Net | None:
    """A network learned from a sample of labelled texts, or None where either quality is missing from it."""
    samples, share = labelled(docs, labels, learn, per_class, seed)
    return train(samples, share, seed=seed) if len({q for _, q in samples}) == 2 else None


def classify(docs: DataFrame, net: Net | None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of every row: the probability of quality 1 and whether it reaches ``threshold``.

    The text alone is read, as bytes, from end to end however long it is. A null text counts as empty; an empty one is scored
    like any other, from zero bytes; repeated rows and rows without an id each get a row; without a network every score is
    0.5; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(net)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        table = net.table() if net else None
        for batch in batches:
            score = [np.zeros(0)]
            for _, texts in texts_in_slices(batch):
                score.append(sigmoid(net.slope * logits(net, table, [t.encode() for t in texts]) + net.offset) if net else np.full(len(texts), 0.5))
            found = np.concatenate(score)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array((found >= threshold).astype("i4"))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", whole().alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
