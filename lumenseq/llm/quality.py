"""Line-first quality rules: bad lines go, then documents that lost too much.

Everything is a column expression over one row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that divides words, and symbols that are counted.
SPACE, SYMBOL = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
WINDOW = 8
#: Punctuation: a line ends a sentence (closing quotes and brackets may follow), ...
ENDS = r"[.!?:;…。！？؟۔।][\"'»”’)\]]*[\x20\x09-\x0D]*$"
#: ... is not made of shouts, and not of symbols: two words in ten with a run of marks, or one character in ten a symbol.
SHOUT, SHOUT_SHARE, SYMBOL_SHARE = r"[!?]{2,}", 0.2, 0.1
#: Navigation: items between bars, arrows or bullets, one separator for four words or fewer.
SEPARATOR, SEPARATOR_SHARE = r"[|»›→•·]", 0.25
#: Boilerplate of pages.
BOILERPLATE = (
    r"(?i)(?:all rights reserved|privacy policy|terms of (?:use|service)|cookie policy|(?:use|uses|accept) (?:of )?cookies"
    r"|enable javascript|subscribe to our newsletter|sign up for our|click here to|back to top|skip to (?:main )?content|lorem ipsum)")
#: A document stays if this share of the characters of its lines stays.
KEPT_SHARE = 0.5


def line_fails(line: Column) -> Column:
    words = F.size(F.split(F.trim(line), SPACE))
    punctuation = ~line.rlike(ENDS) | (F.regexp_count(line, F.lit(SHOUT)) > SHOUT_SHARE * words) | (
        F.regexp_count(line, F.lit(SYMBOL)) > SYMBOL_SHARE * F.length(line))
    return punctuation | (F.regexp_count(line, F.lit(SEPARATOR)) > SEPARATOR_SHARE * words) | line.rlike(BOILERPLATE)


def repeated_words(words: Column, hashes: Column, sorted_windows: Column) -> Column:
    """Words in windows that occur again, from windows sorted by hash."""
    twice = F.filter(sorted_windows, lambda x, j: F.coalesce(F.get(sorted_windows, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(sorted_windows, j + 1)["h"] == x["h"], F.lit(False)))
    starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
    first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(starts, first, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")))["n"]


def rated(docs: DataFrame, text: str = "text") -> DataFrame:
    """Two structs: ``doc`` with all columns of ``docs``, and ``_quality`` with counts, verdicts, share kept and cleaned text."""
    rows = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_words", F.array_remove(F.split("_text", SPACE), ""))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    last = F.size("_words") - WINDOW
    rows = rows.withColumn("_windows", F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get("_hash", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.withColumn("_sorted", F.when(repeats, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))
    rows = rows.withColumn("_good", F.filter("_lines", lambda x: ~line_fails(x)))
    n_words, n_repeat = F.size("_words").cast("long"), repeated_words(F.col("_words"), F.col("_hash"), F.col("_sorted")).cast("long")
    length = F.length(F.array_join("_lines", ""))
    rows = rows.withColumn("_quality", F.struct(
        n_words.alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), n_repeat.alias("n_repeat_words"),
        F.when(length > 0, F.length(F.array_join("_good", "")) / length).otherwise(0.0).alias("share_kept"), F.array_join("_good", "\n").alias("clean_text")))
    rows = rows.withColumn("_quality", F.col("_quality").withField(
        "base_failed", F.expr(f"_quality.n_words < 20 OR 100 * _quality.n_repeat_words > 30 * _quality.n_words")))
    rows = rows.withColumn("_quality", F.col("_quality").withField(
        "kept", ~F.col("_quality.base_failed") & (F.col("_quality.share_kept") >= KEPT_SHARE)))
    return rows.select("doc", "_quality")


def line_quality(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept``, ``share_kept`` and ``clean_text`` of every row of ``docs``.

    A null text has no words and fails; an empty text and one of white space likewise; repeated rows each give a row; long
    texts are read whole; an empty table gives no rows; other columns are not read.
    """
    q = rated(docs.select("doc_id", "text"))
    return q.select("doc.doc_id", *[f"_quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "share_kept", "clean_text")])


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, with bad lines gone and ``n_chars`` counted anew; all other columns as they are.

    A null, empty or white text goes; a very long one is read whole; repeated rows stay as often as they come; an empty table
    gives no rows.
    """
    # the row number keeps the optimizer from copying the whole rule tree into the filter, once for each use of a part of it
    rows = rated(docs).withColumn("_row", F.monotonically_increasing_id()).where("_quality.kept AND _row >= 0")
    new = {"text": F.col("_quality.clean_text")} | ({"n_chars": F.length("_quality.clean_text").cast("long")} if "n_chars" in docs.columns else {})
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"doc.`{c}`") for c in docs.columns])


def oracle() -> str:
    """The same in DuckDB SQL, with windows compared as lists of words."""
    def count(column: str, pattern: str) -> str:
        return f"len(regexp_extract_all({column}, '{pattern}'))"

    words = f"len(list_filter(regexp_split_to_array(trim(l, ' '), '{SPACE}'), lambda x: true))"
    ends, boiler = ENDS.replace("'", "''"), BOILERPLATE.replace("'", "''")
    good = f"""regexp_matches(l, '{ends}') AND {count('l', SHOUT)} <= {SHOUT_SHARE} * {words} AND {count('l', SYMBOL)} <= {SYMBOL_SHARE} * length(l)
        AND {count('l', SEPARATOR)} <= {SEPARATOR_SHARE} * {words} AND NOT regexp_matches(l, '{boiler}')"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT r, i, words[i:i + {WINDOW - 1}] AS g FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
twice AS (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM win JOIN twice USING (r, g), (SELECT unnest(range({WINDOW})) AS k) GROUP BY r),
line AS (SELECT r, l, {good} AS good FROM (SELECT r, unnest(lines) AS l FROM w)),
share AS (SELECT r, coalesce(sum(length(l)) FILTER (good), 0) / sum(length(l)) AS s FROM line GROUP BY r),
c AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, {count('text', SYMBOL)} AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(s, 0) AS s
      FROM w LEFT JOIN covered USING (r) LEFT JOIN share USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND s >= {KEPT_SHARE} AS kept FROM c"""
