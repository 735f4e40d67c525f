"""Themes and extractive digests of positive and negative reviews, and text for later model runs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuelens.functions import text as T
from venuelens.operators.packed import telling_texts
from venuelens.operators.report import polarity_split
from venuelens.operators.skew import top_k
from venuelens.session import stored

NO_REVIEWS = "No reviews available."  # fixed value
POLARITIES = ("positive", "negative")
PIECES = 64
TASK_BYTES = 4 << 20  # of text, whose phrases one task counts
PACKED_TASKS = 2  # so many tasks' worth of packed counts is added up at once


def week_texts(week: DataFrame) -> DataFrame:
    """The week's reviews with text and their polarity, stored once, as their texts are read several times."""
    return stored(polarity_split(week).select(
        "place_name", "polarity", "review_datetime_utc", "review_id", "review_text"), "week-texts")


def text_bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.octet_length("review_text").cast("long"))).first()[0] or 0


def dealt(rows: DataFrame, size: int | None = None) -> DataFrame:
    """Reviews dealt over tasks of ``TASK_BYTES`` of text, of ``size`` in all: those
    of a week lie in few splits of a table, and a task's phrases need many times the memory of its texts."""
    size = text_bytes(rows) if size is None else size
    tasks = max(1, -(-size // TASK_BYTES), min(-(-64 * size // TASK_BYTES), rows.sparkSession.sparkContext.defaultParallelism))
    return rows.repartition(tasks, F.xxhash64("review_id", "review_datetime_utc", "review_text"))


def key_phrases(week: DataFrame, n: int = 20, ngram: int = 2) -> DataFrame:
    """Words and word pairs that tell a place's positive from its negative reviews. The weight is
    the log ratio of smoothed document shares; each review counts a phrase once, and a task's
    counts are added up and packed before the shuffle."""
    return _phrases(week_texts(week), n, ngram)


def _phrases(rows: DataFrame, n: int, ngram: int) -> DataFrame:
    is_pos = (F.col("polarity") == "positive").cast("int").alias("is_pos")
    totals = rows.select("place_name", is_pos).groupBy("place_name").agg(
        F.sum("is_pos").alias("pos_docs"), F.sum(1 - F.col("is_pos")).alias("neg_docs"))
    size = text_bytes(rows)
    worded = dealt(rows, size).select("place_name", is_pos, T.words(F.col("review_text")).alias("words"))
    phrases = worded.select("place_name", "is_pos", T.grams(F.col("words"), ngram).alias("phrases"))
    parts = max(1, -(-size // (PACKED_TASKS * TASK_BYTES)), min(-(-16 * size // TASK_BYTES), PIECES))
    counts = telling_texts(phrases, "place_name", "phrases", "is_pos", parts, "phrase", n)
    share = lambda c, total: (F.col(c) + 1) / (F.col(total) + 2)
    score = F.round(F.log(share("pos", "pos_docs") / share("neg", "neg_docs")), 6)
    side = F.when(F.col("score") > 0, "positive").when(F.col("score") < 0, "negative")
    # a place may hold a large share of the phrases: join and rank it in pieces, then once more
    salt = F.pmod(F.xxhash64("phrase"), F.lit(PIECES)).cast("int")
    totals = totals.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    scored = (counts.withColumn("piece", salt).join(totals, ["place_name", "piece"]).withColumn("score", score)
              .withColumn("polarity", side).filter(F.col("polarity").isNotNull())
              .select("place_name", "piece", "polarity", "phrase", F.abs("score").alias("weight"),
                      F.when(F.col("polarity") == "positive", F.col("pos")).otherwise(F.col("neg")).alias("reviews")))
    order = [F.col("weight").desc(), F.col("reviews").desc(), F.col("phrase")]
    best = top_k(scored, ["place_name", "polarity", "piece"], order, n).drop("piece", "rank")
    return top_k(best, ["place_name", "polarity"], order, n)


def sentences(rows: DataFrame, max_words: int) -> DataFrame:
    """Sentences of the review texts, in place of these, with their ``place_in_text``; a run of more than ``max_words``
    words is cut into pieces of so many."""
    words = lambda s: F.filter(F.split(s, r"\s+", -1), lambda w: w != "")
    # a sentence's words are an argument of the next step, as an expression they would be split again for every piece
    found = F.transform(F.transform(F.split("review_text", r"[.!?\n]+", -1), T.strip), lambda s: F.struct(s.alias("s"), words(s).alias("w")))
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.size(w), F.lit(max_words)),
                                lambda i: F.array_join(F.slice(w, i, F.lit(max_words)), " "))
    pieces = F.flatten(F.transform(found, lambda x: F.when(F.size(x["w"]) > max_words, cut(x["w"])).otherwise(F.array(x["s"]))))
    each = T.each(rows, pieces, "sentence", "pos").filter(F.col("sentence") != "")
    return each.withColumn("place_in_text", F.struct("review_datetime_utc", "review_id", "pos")).drop(
        "review_text", "review_datetime_utc", "review_id", "pos")


def review_digest(week: DataFrame, max_words: int = 200, n: int = 20, ngram: int = 2) -> DataFrame:
    """The heaviest sentences per place and polarity, up to ``max_words`` words in all."""
    rows = week_texts(week)
    # at most n phrases per place and polarity travel as one array; stored, as their size tells whether texts must move to meet them
    weights = stored(_phrases(rows, n, ngram).groupBy("place_name", "polarity")
                     .agg(F.collect_list(F.struct("phrase", "weight")).alias("phrases")), "week-phrases")
    weights = weights.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    met = rows.withColumn("piece", F.pmod(F.xxhash64("review_id", "review_datetime_utc"), F.lit(PIECES)).cast("int")).join(
        weights, ["place_name", "polarity", "piece"]).drop("piece")
    worded = T.once(sentences(met, max_words), T.words(F.col("sentence")), "words")
    worded = T.once(worded, T.grams(F.col("words"), ngram), "grams")
    weight = F.aggregate(F.filter("phrases", lambda p: F.array_contains("grams", p["phrase"])), F.lit(0.0), lambda s, p: s + p["weight"])
    lines = T.once(worded, F.when(F.arrays_overlap("grams", F.col("phrases.phrase")), F.round(weight, 6)), "score")
    # sentences without a phrase go before any are gathered; equal ones of a place and polarity, of one score, become one row
    # that stands where the first of them stood
    scored = (lines.filter(F.col("score") > 0)
              .groupBy("place_name", "polarity", "sentence", "score").agg(F.min("place_in_text").alias("place_in_text"))
              .withColumn("n_words", F.size(F.filter(F.split("sentence", r"\s+", -1), lambda w: w != "")))
              .withColumn("piece", F.pmod(F.xxhash64("sentence"), F.lit(PIECES)).cast("int")))
    order = [F.col("score").desc(), F.col("place_in_text"), F.col("sentence")]
    # a chosen sentence has a word or more, so the first max_words sentences decide
    best = top_k(scored, ["place_name", "polarity", "piece"], order, max_words).drop("rank", "piece")
    best = top_k(best, ["place_name", "polarity"], order, max_words)
    so_far = (Window.partitionBy("place_name", "polarity").orderBy("rank")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = best.withColumn("run", F.sum("n_words").over(so_far)).filter(F.col("run") <= max_words)
    digest = kept.groupBy("place_name", "polarity").agg(
        F.sort_array(F.collect_list(F.struct("rank", "sentence"))).alias("s"),
        F.sum("n_words").alias("n_words"))
    spine = (week.select("place_name").distinct()
             .withColumn("polarity", F.explode(F.array(*[F.lit(p) for p in POLARITIES]))))
    joined = F.array_join(F.transform("s", lambda x: x["sentence"]), ". ")
    return spine.join(digest, ["place_name", "polarity"], "left").select(
        "place_name", "polarity", F.coalesce("n_words", F.lit(0)).alias("n_words"),
        F.coalesce(joined, F.lit(NO_REVIEWS)).alias("digest"))


def prompt_batch(rows: DataFrame, template: str, out: str = "prompt") -> DataFrame:
    """``{column}`` places in the template filled per row; a null shows as nothing."""
    parts: list[Column] = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            parts.append(F.coalesce(F.col(piece).cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return rows.withColumn(out, F.concat(*parts))


def pipe_rows(df: DataFrame) -> DataFrame:
    """Rows as ``a | b | c`` text, next to the heading in the same form."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.select(F.lit(" | ".join(df.columns)).alias("header"), F.concat_ws(" | ", *shown).alias("line"))


def request_parse(requests: DataFrame) -> DataFrame:
    """Question, ratings and dates out of one request text, by its ``$$``, ``**`` and ``^^`` marks.
    All three are needed; without them the row is null but for its id."""
    found = lambda mark: F.regexp_extract("request", rf"{mark}(.+){mark}", 1)
    q, r, d = found(r"\$\$"), found(r"\*\*"), found(r"\^\^")
    whole = (q != "") & (r != "") & (d != "")
    ratings = F.transform(F.split(r, ",", -1), lambda x: T.strip(x).try_cast("int"))
    return requests.select("request_id", F.when(whole, T.strip(q)).alias("question"),
                           F.when(whole, ratings).alias("ratings"), F.when(whole, F.split(d, ",", -1)).alias("dates"))


def request_text(requests: DataFrame) -> DataFrame:
    """The request text for a question, its ratings and its inclusive date range."""
    days = day_list(F.col("start_date").cast("date"), F.col("end_date").cast("date"))
    dates = F.array_join(F.transform(days, lambda d: F.date_format(d, "dd-MM-yyyy")), ",")
    return requests.select("request_id", F.concat(
        F.lit("Rating:**"), "rating", F.lit("** \nQuestion:$$ "), "question", F.lit(" $$ \nDates:^^"), dates,
        F.lit("^^\n")).alias("request"))


def day_list(start: Column, end: Column) -> Column:
    """Inclusive; empty when the end lies before the start (``sequence`` would count down)."""
    return F.when(end >= start, F.sequence(start, end)).otherwise(F.array().cast("array<date>"))
