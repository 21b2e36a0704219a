"""Column expressions shared by the operators; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NLL_CLIP = 1e-12
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def cell(column: Column) -> Column:
    """Trimmed text of a CSV cell; a missing cell is the empty string."""
    return F.regexp_replace(F.coalesce(column.cast("string"), F.lit("")), _EDGE_SPACE, "")


def cell_sql(name: str) -> str:
    """``cell`` as SQL text, for projections that clean many columns at once."""
    return f"regexp_replace(coalesce(cast({name} as string), ''), r'{_EDGE_SPACE}', '')"


def is_blank(column: Column) -> Column:
    return cell(column) == ""


def is_digits(column: Column) -> Column:
    return column.rlike("^[0-9]+$")


def is_int_token(column: Column) -> Column:
    return column.rlike("^-?[0-9]+$")


def is_kc_token(column: Column) -> Column:
    """Canonical decimal integer: no leading zeros, optional minus sign."""
    return column.rlike("^(0|-?[1-9][0-9]*)$")


def tag_tokens_sql(tags: str) -> str:
    """Non-empty trimmed tokens of a semicolon list; blank and -1 cells are empty."""
    text = cell_sql(tags)
    tokens = f"filter(transform(split({text}, ';'), t -> {cell_sql('t')}), t -> t != '')"
    return f"if({text} in ('', '-1'), cast(array() as array<string>), {tokens})"


def invalid_tag_sql(tags: str) -> str:
    """First token that is not a non-negative integer, or null."""
    return f"try_element_at(filter({tag_tokens_sql(tags)}, t -> not (t rlike '^[0-9]+$')), 1)"


def parse_tags(tags: str, question: str = "'?'") -> Column:
    """KC ids in stored order with repeats; an invalid token fails the query.

    ``tags`` and ``question`` are SQL expressions, usually column names.
    """
    bad = invalid_tag_sql(tags)
    message = f"concat('question ', {question}, ': tags \"', {tags}, '\" has invalid token \"', {bad}, '\"')"
    return F.expr(
        f"if({bad} is null, transform({tag_tokens_sql(tags)}, t -> cast(t as bigint)), "
        f"cast(raise_error({message}) as array<bigint>))"
    )


def repeats_kc(kc_ids: Column) -> Column:
    return F.size(kc_ids) != F.size(F.array_distinct(kc_ids))


def bundle_or_interaction(bundle: Column, interaction: Column) -> Column:
    """Trimmed bundle id, or the interaction id when the bundle is blank."""
    trimmed = cell(bundle)
    return F.when(trimmed == "", interaction).otherwise(trimmed)


def join_key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def solving_of_bundle(learner: Column, bundle: Column) -> Column:
    """Integer after ``learner|`` in a bundle id, or null when it has another form."""
    suffix = F.substring(bundle, F.length(learner) + 2, F.length(bundle))
    ok = F.startswith(bundle, F.concat(learner, F.lit("|"))) & is_digits(suffix)
    return F.when(ok, suffix.try_cast("long"))


def source_row_of_id(interaction: Column) -> Column:
    return F.substring_index(interaction, ":", -1).try_cast("long")


def sigmoid(x: Column) -> Column:
    """Logistic function that never overflows."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + small)).otherwise(small / (1.0 + small))


def mean_or_zero(values: Column) -> Column:
    """Mean of an array with repeats kept; an empty array gives 0."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(0.0)


def nll_term(correct: Column, p: Column) -> Column:
    clipped = F.least(F.greatest(p, F.lit(NLL_CLIP)), F.lit(1.0 - NLL_CLIP))
    y = correct.cast("double")
    return -(y * F.log(clipped) + (1.0 - y) * F.log(1.0 - clipped))


def brier_term(correct: Column, p: Column) -> Column:
    return F.pow(p - correct.cast("double"), 2)


def short_history_cut(n: Column) -> tuple[Column, Column]:
    """70/10 counts with half-even rounding and the short-history adjustment."""
    train = F.greatest(F.lit(1.0), F.rint(n * 0.70)).cast("long")
    valid = F.greatest(F.lit(1.0), F.rint(n * 0.10)).cast("long")
    fitted = F.when(train + valid >= n, F.greatest(F.lit(0).cast("long"), n - train - 1)).otherwise(valid)
    return train, fitted


def split_label(rank: Column, train: Column, valid: Column) -> Column:
    return F.when(rank < train, "train").when(rank < train + valid, "valid").otherwise("test")


def row_identity(user: str = "learner_id", source_row: str = "source_row", question: str = "item_id", solving: str = "solving_id", timestamp: str = "timestamp") -> Column:
    """Stable identity of a raw row as a struct; its KCs are not part of it."""
    return F.struct(F.col(user).alias("user_id"), F.col(source_row).cast("long").alias("source_row"), F.col(question).alias("question_id"),
                    F.col(solving).cast("long").alias("solving_id"), F.col(timestamp).cast("long").alias("timestamp"))
