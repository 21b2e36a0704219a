"""Token counts by a two-tier lookup on the map side.

Tier one is a broadcast table with the lengths of the corpus's most frequent pre-tokens. Tier two is a cache in each
Python worker for the rest, filled by the tokenizer itself. No pre-token of a text is shuffled: finding the frequent ones
moves at most ``PER_TASK`` counted rows a task.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenseq.llm import word_bpe as W
from lumenseq.llm.common import texts_in_slices, whole

#: Entries of the broadcast table and of one task's report; what a task counts at once.
FREQUENT, PER_TASK, HELD = 32_768, 8_192, 200_000
#: Longest pre-token of the table, in characters, so that its keys stay under 2.1 million characters (about 0.5 MB for prose).
LONGEST = 64


def frequent_pieces(docs: DataFrame, path: str, most: int = FREQUENT) -> dict[str, int]:
    """About the ``most`` most frequent pre-tokens of up to ``LONGEST`` characters of all texts, with their token counts.

    Every text is read. A task counts in bounded memory, dropping its rarest half when full, so a rare pre-token may be
    missed; that costs a cache miss later and never changes a count.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for _, texts in texts_in_slices(batch):
                seen.update(p for t in texts for p in W.pieces(path, t) if len(p) <= LONGEST)
                if len(seen) > HELD:
                    seen = Counter(dict(seen.most_common(HELD // 2)))
        top = seen.most_common(PER_TASK)
        yield pa.RecordBatch.from_pydict({"piece": pa.array([p for p, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    top = (
        docs.select(whole().alias("text")).mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece").limit(most).collect()
    )
    found = [r.piece for r in top]
    return {piece: len(W.encode_piece(path, piece)) for piece in found}


def token_counts(docs: DataFrame, limit: int = 2048, path: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    A null text counts as empty (0 bytes, 0 tokens); repeated rows each give a row; an empty table gives no rows; other
    columns are not read, so their names cannot clash. Strings of special tokens inside a text are special tokens, as the
    library has it.
    """
    path = path or W.default_path()
    table = frequent_pieces(docs, path)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(("\n".join(table), array("I", table.values()).tobytes()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lengths = shared.value
        first_tier = dict(zip(names.split("\n"), array("I", lengths), strict=False))
        known = dict(first_tier)
        for batch in batches:
            n_tokens: list[int] = []
            for _, texts in texts_in_slices(batch):
                split = [W.pieces(path, t) for t in texts]
                needed = set(chain.from_iterable(split))
                missing = needed.difference(known)
                if len(known) + len(missing) > W.CACHE_ENTRIES:
                    known = dict(first_tier)
                    missing = needed.difference(known)
                known.update((piece, len(W.encode_piece(path, piece))) for piece in missing)
                n_tokens += [sum(map(known.__getitem__, p)) for p in split]
                for piece in missing:
                    if len(piece) > LONGEST:
                        del known[piece]  # the cache is bounded in entries, so it holds short ones only
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    rows = docs.select("doc_id", F.octet_length(whole()).cast("long").alias("n_bytes"), whole().alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
