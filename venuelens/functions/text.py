"""Text expressions, all native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE_SPACE = r"(?U)^\s+|\s+$"
WORD_BREAK = r"[^\p{L}\p{N}']+"
STOP_WORDS = (
    "a an and are as at be been but by for from had has have he her his i in is it its "
    "me my not of on or our she so that the their them they this to us was we were "
    "what when which who will with you your"
).split()


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACE, "")


def preview(text: Column, limit: int, missing: str) -> Column:
    """First ``limit`` characters, then each line break becomes one space."""
    shown = F.translate(F.substring(text, 1, limit), "\n\r", "  ")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(missing)).otherwise(shown)


def indian_rupees(amount: Column) -> Column:
    """Whole rupees with Indian digit grouping: 1237257 is shown as ₹12,37,257."""
    digits = F.format_string("%s", F.round(amount, 0).cast("decimal(38,0)"))
    grouped = F.regexp_replace(digits, r"(?<=\d)(?=(\d\d)+\d$)", ",")
    return F.concat(F.lit("₹"), grouped)


def words(text: Column) -> Column:
    """Lower-case words without stop words, in order."""
    tokens = F.split(F.lower(text), WORD_BREAK, -1)
    return F.filter(tokens, lambda t: ~t.isin("", *STOP_WORDS))


def grams(tokens: Column, n: int) -> Column:
    """Distinct 1- to n-grams of a word array. Pass a column, not a long expression: it is used often."""
    out, run = tokens, tokens
    for size in range(2, n + 1):
        # each run of size - 1 words with the word after it; the last one has none
        count = F.greatest(F.size(tokens) - (size - 1), F.lit(0))
        run = F.zip_with(F.slice(run, F.lit(1), count), F.slice(tokens, F.lit(size), count),
                         lambda a, b: F.concat(a, F.lit(" "), b))
        out = F.concat(out, run)
    return F.array_distinct(out)


def pieces(value: Column, size: int) -> Column:
    """All pieces of ``size`` characters, in order; none for a shorter value."""
    starts = F.when(F.length(value) >= size, F.sequence(F.lit(1), F.length(value) - (size - 1))
                    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(value, i, F.lit(size)))


def trigrams(value: Column) -> Column:
    """Distinct three-letter pieces of the lower-case value, padded so that short
    values and word starts have some."""
    return F.array_distinct(pieces(F.concat(F.lit("  "), F.lower(value), F.lit(" ")), 3))


def each(df: DataFrame, values: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per element of a computed array. A plain ``explode`` would make Spark add a filter
    on the array, evaluate it a second time and push it below aggregates, to every input row."""
    if position is None:
        rows = df.withColumn(name, F.explode_outer(values))
    else:
        rows = df.select("*", F.posexplode_outer(values).alias(position, name))
    return rows.filter(F.col(name).isNotNull())


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """A computed column that later steps use as it is. From a plain one Spark takes the expression, and evaluates it at
    each use and for each element of a loop around it."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def without_numbers(value: Column) -> Column:
    """Stand-alone whole numbers removed, then trimmed."""
    return strip(F.regexp_replace(value, r"\b\d+\b", ""))
