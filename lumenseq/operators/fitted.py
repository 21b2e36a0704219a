"""User models that train on a whole table, store a checkpoint and replay from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenseq.operators import replay as R
from lumenseq.operators.models import REQUIRED_METADATA, AbilityModel


class FittedModel:
    """Second user surface, beside ``BundleModel``: whole-table ``train`` and ``replay``.

    ``train`` returns the named tables of the checkpoint. ``replay`` gets rows of later phases in ``seq`` order and the
    tables read back from storage, and returns ``seq, interaction_id, probability`` for every row; what it carries
    from bundle to bundle starts from the checkpoint alone. ``metadata`` is checked like that of a ``BundleModel``.
    """

    metadata: dict[str, str] = {}
    accepts_oov: tuple[str, ...] | None = None

    def train(self, rows: DataFrame) -> dict[str, DataFrame]:
        raise NotImplementedError

    def replay(self, rows: DataFrame, checkpoint: dict[str, DataFrame]) -> DataFrame:
        raise NotImplementedError


def check_fitted(model: FittedModel, oov_semantics: str | None = None) -> None:
    """Plan-time contract check, before any row is read."""
    for name in ("train", "replay"):
        if not callable(getattr(model, name, None)):
            raise TypeError(f"model lacks {name}()")
    missing = [n for n in REQUIRED_METADATA if not isinstance(model.metadata.get(n), str) or not model.metadata[n]]
    if missing:
        raise ValueError(f"model metadata lacks {missing}")
    if oov_semantics is not None and model.accepts_oov is not None and oov_semantics not in model.accepts_oov:
        raise ValueError(f"model does not accept out-of-vocabulary semantics {oov_semantics!r}")


class ItemRateModel(FittedModel):
    """Difficulty of an item from its smoothed share of right TRAIN answers; abilities start at zero and step bundle by bundle.

    An item that TRAIN has not seen has difficulty 0.
    """

    metadata = dict.fromkeys(REQUIRED_METADATA, "item-rate-v1")

    def train(self, rows):
        counts = rows.groupBy("item_id").agg(F.sum("correct").alias("right"), F.count(F.lit(1)).alias("n"))
        return {"items": counts.select("item_id", F.log((F.col("n") - F.col("right") + 1) / (F.col("right") + 1)).alias("b"))}

    def replay(self, rows, checkpoint):
        scored = R.trace_of(R.replay(R.attach_difficulty(rows, checkpoint["items"]), AbilityModel(), keep=("interaction_id",)))
        return scored.select("seq", "interaction_id", "probability")


def table_digest(table: DataFrame) -> str:
    """SHA-256 over row count and sums of row hashes: any row order and file layout gives the same digest, other rows another.

    Rows are hashed where they lie and summed in four parts of 60 bits; repeated rows count.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = [F.coalesce(F.sum(p), F.lit(0)).cast("string") for p in parts]
    found = table.select(row.alias("_h")).agg(F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *sums), 256).alias("digest"))
    return found.first()["digest"]
