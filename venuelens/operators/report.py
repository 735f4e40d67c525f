"""Weekly report: windows, distributions, trends, comparisons and their wording."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from venuelens.functions import clock
from venuelens.functions.ratings import question_map, sub_rating
from venuelens.functions.text import each, pieces
from venuelens.operators.skew import numbered, top_k
from venuelens.operators.summary import STARS, star_counts
from venuelens.sources.tables import WEEKLY_REPORT

RATINGS = [1, 2, 3, 4, 5]
PATTERN_BLOCK = 64
NAME_SALTS = 32


# --- rows of a place, of a week, of a polarity ---

def place_match_regex(reviews: DataFrame, pattern: str) -> DataFrame:
    """Names that contain the pattern, ignoring case; a null name never matches."""
    return reviews.filter(F.col("place_name").rlike(f"(?iu){pattern}"))


def _fold(name: Column) -> Column:
    return F.lower(F.upper(name))


def required_literal(pattern: str) -> str:
    """A text that every match of the regular expression holds (in any case), the longest found; empty if none is sure.
    Only what stands outside groups and classes counts, a character less where it may be repeated zero times. An
    alternative at the top, an inline group option or a numeric escape gives none."""
    best, run, i, n = "", "", 0, len(pattern)

    def end_of_class(at: int) -> int:
        depth = 0
        while at < n:
            if pattern[at] == "\\":
                at += 1
            elif pattern[at] == "[":
                depth += 1
            elif pattern[at] == "]":
                depth -= 1
                if not depth:
                    return at
            at += 1
        return n

    def end_of_group(at: int) -> int:
        depth = 0
        while at < n:
            if pattern[at] == "\\":
                at += 1
            elif pattern[at] == "[":
                at = end_of_class(at)
            elif pattern[at] in "()":
                depth += 1 if pattern[at] == "(" else -1
                if not depth:
                    return at
            at += 1
        return n

    if any(mark in pattern for mark in ("(?", "\\Q", "[]", "[^]")):
        return ""
    while i < n:
        c = pattern[i]
        if c == "|":
            return ""
        if c in "?*{":
            run = run[:-1]
        if c == "\\":
            i += 1
            if i == n or pattern[i] in "xucpPkNXE0123456789":
                return ""
            if not pattern[i].isalnum():
                run, c = run + pattern[i], ""
        elif c == "[":
            i = end_of_class(i)
        elif c == "(":
            i = end_of_group(i)
        elif c == "{":
            i = pattern.find("}", i)
            if i < 0:
                return ""
        elif c not in ".^$?*+":
            run, c = run + c, ""
        if c:  # something other than a plain character: the run ends here
            best, run = max(best, run, key=len), ""
        elif len(run) > len(best) and (i + 1 == n or pattern[i + 1] not in "?*{"):
            best = run
        i += 1
    return best


@F.pandas_udf(StringType())
def _literals(patterns: pd.Series) -> pd.Series:
    return patterns.map(required_literal)


def match_names(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, place_name) for every name that contains the pattern, over distinct names only.
    A pattern is looked up by the first piece of a text that its matches must hold; names that hold the piece are
    tested. A regular expression without such a text (``required_literal``) is packed in blocks with others, and
    each name tests a block at a time; names are dealt over ``NAME_SALTS`` copies of a block."""
    names = names.select("place_name").filter(F.col("place_name").isNotNull()).distinct()
    wanted = (patterns.select(F.col("place_name").alias("pattern"))
              .filter(F.col("pattern").isNotNull()).distinct())
    special = F.col("pattern").rlike(r"[\\^$.|?*+()\[\]{}]")
    hit = F.expr("place_name rlike concat('(?iu)', pattern)")

    known = wanted.filter(~special).withColumn("literal", F.col("pattern")).unionByName(
        wanted.filter(special).withColumn("literal", _literals("pattern")))
    keyed = known.filter("literal <> ''").withColumn("piece", F.substring(_fold(F.col("literal")), 1, 3))
    folded = _fold(F.col("place_name"))
    index = each(names, F.array_distinct(F.concat(*[pieces(folded, size) for size in (1, 2, 3)])), "piece")
    found = index.join(keyed, "piece").filter(hit).select("pattern", "place_name")

    regex = known.filter("literal = ''").select("pattern")
    n_blocks = -(-regex.count() // PATTERN_BLOCK)
    if n_blocks:
        blocks = (regex.groupBy(F.pmod(F.xxhash64("pattern"), F.lit(n_blocks)).cast("int").alias("block"))
                  .agg(F.collect_list("pattern").alias("pats"))
                  .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(NAME_SALTS - 1)))))
        tested = (names.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
                  .withColumn("salt", F.pmod(F.xxhash64("place_name"), F.lit(NAME_SALTS)).cast("int"))
                  .join(blocks, ["block", "salt"])
                  .select("place_name", F.explode("pats").alias("pattern")).filter(hit))
        found = found.unionByName(tested.select("pattern", "place_name"))
    return found


def place_reviews_theta(reviews: DataFrame, places: DataFrame, match: str = "equals") -> DataFrame:
    """Reviews per place name: by equality, or (``match='regex'``) by contained pattern."""
    if match == "equals":
        pairs = places.select(F.col("place_name").alias("pattern"), "place_name")
    else:
        pairs = match_names(reviews, places)
    return reviews.join(pairs, "place_name")


def week_assign(reviews: DataFrame, as_of: datetime) -> DataFrame:
    """Reviews of the two report weeks with ``week`` = current / previous and the local date."""
    prev, cur, end = clock.week_bounds(as_of)
    ts = F.col("review_datetime_utc")
    return (reviews.filter(clock.between(ts, prev, end))
            .withColumn("week", F.when(ts >= clock.ntz(cur), "current").otherwise("previous"))
            .withColumn("review_date", clock.ist_date(ts)))


def current_week(reviews: DataFrame, as_of: datetime) -> DataFrame:
    _, cur, end = clock.week_bounds(as_of)
    ts = F.col("review_datetime_utc")
    return reviews.filter(clock.between(ts, cur, end)).withColumn("review_date", clock.ist_date(ts))


def polarity_split(week: DataFrame) -> DataFrame:
    """Reviews with text, marked positive (4, 5) or negative (1, 2, 3)."""
    r = F.col("review_rating")
    return (week.filter(F.col("review_text").isNotNull() & r.isin(RATINGS))
            .withColumn("polarity", F.when(r >= 4, "positive").otherwise("negative")))


def polarity_text(week: DataFrame, part_size: int = 500) -> DataFrame:
    """Review texts joined by a space per place and polarity, cut into parts of at most ``part_size``
    reviews so that no row holds an unbounded text; the parts in order make the whole."""
    split = polarity_split(week).select("place_name", "polarity", "review_datetime_utc", "review_id", "review_text")
    rows = numbered(split, ["review_datetime_utc", "review_id"], ["place_name", "polarity"])
    part = F.floor((F.col("row_no") - 1) / part_size).alias("part_no")
    texts = F.sort_array(F.collect_list(F.struct("row_no", "review_text")))
    return rows.groupBy("place_name", "polarity", part).agg(
        F.count(F.lit(1)).alias("review_count"),
        F.array_join(F.transform(texts, lambda r: r["review_text"]), " ").alias("joined_text"))


# --- aggregates ---

def report_insights(week: DataFrame) -> DataFrame:
    parsed = week.withColumn("_q", question_map(F.col("review_questions")))
    rated = parsed.select(
        "place_name", "review_rating", "review_questions", "_q",
        *[sub_rating(F.col("_q"), n).alias(n) for n in ("Food", "Service", "Atmosphere")])
    bad = F.col("review_questions").isNotNull() & F.col("_q").isNull()
    return rated.groupBy("place_name").agg(
        F.round(F.avg("Food"), 4).alias("food"), F.round(F.avg("Service"), 4).alias("service"),
        F.round(F.avg("Atmosphere"), 4).alias("atmosphere"), F.count(F.lit(1)).alias("total_reviews"),
        F.round(F.avg("review_rating"), 4).alias("average_rating"),
        F.count(F.when(bad, 1)).alias("bad_questions"))


def _star_counts() -> list[Column]:
    return [F.count(F.when(F.col("review_rating") == r, 1)).alias(f"stars_{r}") for r in RATINGS]


def rating_distribution(week: DataFrame) -> DataFrame:
    """Counts for 1 to 5, zero where missing; other ratings are not counted."""
    return week.groupBy("place_name").agg(*_star_counts())


def top_authors(week: DataFrame, n: int = 10) -> DataFrame:
    counts = (week.filter(F.col("author_title").isNotNull())
              .groupBy("place_name", "author_title").agg(F.count(F.lit(1)).alias("review_count")))
    return top_k(counts, ["place_name"], [F.col("review_count").desc(), F.col("author_title")], n)


def distribution_insights(dist: DataFrame) -> DataFrame:
    """Most common rating (the lower one on a tie) and shares of high and low ratings in percent."""
    c = [F.col(f"stars_{r}") for r in RATINGS]
    total = c[0] + c[1] + c[2] + c[3] + c[4]
    best = F.greatest(*[F.struct(c[r - 1].alias("n"), F.lit(-r).alias("r")) for r in RATINGS])
    share = lambda part: F.round(F.try_divide(part * F.lit(100.0), total), 1)
    return dist.select(
        "place_name", (-best["r"]).alias("most_common_rating"), best["n"].alias("most_common_count"),
        total.alias("total_reviews"), share(c[3] + c[4]).alias("high_percent"),
        share(c[0] + c[1]).alias("low_percent"))


def _rounded(value: Column, digits: int | None) -> Column:
    return value if digits is None else F.round(value, digits)


def trend_daily(week: DataFrame, digits: int | None = 4) -> DataFrame:
    """Seven days from each place's first day with a review. An empty day has total 0 and no mean;
    total and mean count every rating given, the star columns only 1 to 5. ``week`` holds a week,
    so a place's days fit one array, and the calendar is laid over it in the same pass."""
    stars = [f"stars_{r}" for r in RATINGS]
    days = week.groupBy("place_name", "review_date").agg(
        *_star_counts(), F.count("review_rating").alias("total"), F.sum("review_rating").alias("rating_sum"))
    packed = days.groupBy("place_name").agg(
        F.min("review_date").alias("first_day"),
        F.map_from_entries(F.collect_list(F.struct(
            "review_date", F.struct(*stars, "total", "rating_sum")))).alias("by_day"))
    laid = packed.select("place_name", "by_day", F.explode(F.sequence(
        F.col("first_day"), F.date_add("first_day", 6))).alias("review_date"))
    one = laid.withColumn("d", F.try_element_at("by_day", F.col("review_date")))
    zero = lambda c: F.coalesce(F.col(f"d.{c}"), F.lit(0)).alias(c)
    return one.select("place_name", "review_date", *[zero(c) for c in stars], zero("total"),
                      _rounded(F.try_divide(F.col("d.rating_sum"), F.col("d.total")), digits).alias("average_rating"))


def trend_extremes(trend: DataFrame) -> DataFrame:
    """Busiest and quietest day (the earliest on a tie) with their means, and the range of means."""
    early = -F.datediff("review_date", F.lit("1970-01-01").cast("date"))
    row = F.struct("review_date", "total", "average_rating")
    most = F.max_by(row, F.struct("total", early.alias("d")))
    least = F.min_by(row, F.struct("total", (-early).alias("d")))
    return trend.groupBy("place_name").agg(
        most.alias("m"), least.alias("l"), F.min("average_rating").alias("lowest_average"),
        F.max("average_rating").alias("highest_average")).select(
        "place_name", F.col("m.review_date").alias("most_date"), F.col("m.total").alias("most_count"),
        F.col("m.average_rating").alias("most_average"), F.col("l.review_date").alias("least_date"),
        F.col("l.total").alias("least_count"), F.col("l.average_rating").alias("least_average"),
        "lowest_average", "highest_average")


def _move(now: Column, before: Column, up: str, down: str) -> Column:
    return F.when(now > before, up).when(now < before, down).otherwise("same")


def _comparison(reviews: DataFrame, as_of: datetime, with_history: bool) -> DataFrame:
    prev, cur, end = clock.week_bounds(as_of)
    ts, r = F.col("review_datetime_utc"), F.col("review_rating")
    now, before = clock.between(ts, cur, end), clock.between(ts, prev, cur)
    rows = reviews if with_history else reviews.filter(clock.between(ts, prev, end))
    aggs = [F.count(F.when(before, 1)).alias("previous_count"), F.count(F.when(now, 1)).alias("current_count"),
            F.avg(F.when(before, r)).alias("previous_average"), F.avg(F.when(now, r)).alias("current_average")]
    if with_history:
        aggs.append(F.avg(r).alias("historic_average"))
    return rows.groupBy("place_name").agg(*aggs)


def week_comparison(reviews: DataFrame, as_of: datetime, digits: int | None = 4) -> DataFrame:
    """Both weeks side by side in one pass. A missing mean compares as the same; without ``digits`` means are raw."""
    raw = _comparison(reviews, as_of, with_history=False)
    count_move = _move(F.col("current_count"), F.col("previous_count"), "up", "down")
    mean_move = _move(F.col("current_average"), F.col("previous_average"), "up", "down")
    both = raw.withColumn("count_change", count_move).withColumn("average_change", mean_move)
    verdict = F.lit("no significant change")
    for c, m, text in (("up", "up", "improved"), ("down", "down", "dropped"),
                       ("up", "down", "more reviews, lower rating"), ("down", "up", "fewer reviews, higher rating")):
        verdict = F.when((F.col("count_change") == c) & (F.col("average_change") == m), text).otherwise(verdict)
    return both.select(
        "place_name", "previous_count", "current_count", _rounded(F.col("previous_average"), digits).alias("previous_average"),
        _rounded(F.col("current_average"), digits).alias("current_average"), "count_change", "average_change",
        verdict.alias("verdict"))


def historic_average(reviews: DataFrame, as_of: datetime) -> DataFrame:
    """All-time mean next to the current week's, 0 where there is none."""
    raw = _comparison(reviews, as_of, with_history=True)
    zero = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 2).alias(c)
    return raw.select("place_name", F.col("current_count").alias("total_reviews"),
                      zero("current_average"), zero("historic_average"))


def week_over_week(reviews: DataFrame) -> DataFrame:
    """Each local calendar week against the one before it, for every week with reviews."""
    weeks = (reviews.groupBy("place_name", week_start()).agg(
        F.count(F.lit(1)).alias("review_count"), F.avg("review_rating").alias("avg_raw")))
    w = Window.partitionBy("place_name").orderBy("week_start")  # weeks of a place: a few hundred rows
    prev_n, prev_avg = F.lag("review_count").over(w), F.lag("avg_raw").over(w)
    return weeks.select(
        "place_name", "week_start", "review_count", F.round("avg_raw", 4).alias("average_rating"),
        (F.col("review_count") - prev_n).alias("count_delta"),
        F.round(F.col("avg_raw") - prev_avg, 4).alias("average_delta"))


def week_start() -> Column:
    d = clock.ist_date(F.col("review_datetime_utc"))
    return F.date_sub(d, F.weekday(d)).alias("week_start")


def distribution_weekly(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("place_name", week_start()).agg(*_star_counts())


def sentiment_overall(reviews: DataFrame) -> DataFrame:
    """Mean score with a missing score as 0, and the shares of positive and negative ratings."""
    r = F.col("review_rating")
    share = lambda cond: F.round(F.count(F.when(cond, 1)) / F.count(F.lit(1)), 4)
    return reviews.groupBy("place_name").agg(
        F.round(F.avg(F.coalesce("sentiment_score", F.lit(0.0))), 6).alias("average_sentiment"),
        share(r.isin(4, 5)).alias("positive_share"), share(r.isin(1, 2, 3)).alias("negative_share"))


def report_due(places: DataFrame, state: DataFrame, as_of: datetime, report_type: str = WEEKLY_REPORT) -> DataFrame:
    """Places without a report since Monday of this week."""
    monday = (as_of - timedelta(days=as_of.weekday())).date()
    done = state.filter((F.col("report_type") == report_type)
                        & (F.col("last_report_date") >= clock.day(monday))).select("place_name")
    return places.join(done, "place_name", "left_anti")


def dashboard_metrics(reviews: DataFrame) -> DataFrame:
    """Count, mean and stars per place and, with a null place, over all reviews, those without a place included."""
    return reviews.rollup("place_name").agg(
        F.grouping("place_name").alias("_all"), F.count(F.lit(1)).alias("total_reviews"),
        F.round(F.avg("review_rating"), 4).alias("average_rating"), *star_counts()).filter(
        (F.col("_all") == 1) | F.col("place_name").isNotNull()).drop("_all")


# --- daily states: counts and sums that merge by adding ---

def daily_states(reviews: DataFrame) -> DataFrame:
    """Per place and local day: reviews, ratings given and their sum, and the star counts. Everything the summaries
    show follows by adding these. A review without a time has a null day."""
    return reviews.groupBy("place_name", clock.ist_date(F.col("review_datetime_utc")).alias("review_date")).agg(
        F.count(F.lit(1)).alias("total_reviews"), F.count("review_rating").alias("rated"),
        F.sum(F.col("review_rating").cast("long")).alias("rating_sum"), *star_counts())


def save_daily_states(states: DataFrame, path: str) -> None:
    """A folder per day; only the days present in ``states`` are replaced."""
    (states.repartition("review_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("review_date").parquet(path))


def refresh_daily_states(reviews: DataFrame, days: list[date], path: str) -> None:
    """Counts the given local days anew from the reviews of those days alone. A day that has no review any more
    keeps an empty row of place null, which adds nothing."""
    spark = reviews.sparkSession
    wanted = spark.createDataFrame([(d,) for d in days], "review_date date")
    span = clock.between(F.col("review_datetime_utc"), datetime.combine(min(days), time.min) - clock.OFFSET,
                         datetime.combine(max(days), time.min) - clock.OFFSET + timedelta(days=1))
    made = daily_states(reviews.filter(span)).filter(F.col("review_date").isin(days))
    zero = [F.lit(0).cast("long").alias(c) for c in made.columns[2:]]
    empty = wanted.select(F.lit(None).cast("string").alias("place_name"), "review_date", *zero)
    save_daily_states(made.unionByName(empty), path)


def merged_states(states: DataFrame, *keys: str) -> DataFrame:
    """Count, mean and stars by ``keys`` (place_name, review_date, both or neither) out of daily states."""
    sums = ["total_reviews", "rated", "rating_sum", *STARS.values()]
    one = states.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    return one.select(*keys, "total_reviews", F.round(F.try_divide("rating_sum", "rated"), 4).alias("average_rating"),
                      *STARS.values())


def dashboard(states: DataFrame, as_of: datetime) -> DataFrame:
    """The figures of ``dashboard_metrics`` with the trend of the week before ``as_of`` beside them, out of daily states:
    per place, and with a null place over all reviews, a row for each of seven days from the first day with a
    review. Without one in that week there is one row, its day null. A place's days fit one array."""
    _, cur, end = clock.week_bounds(as_of)
    first, last = ((t + clock.OFFSET).date() for t in (cur, end))
    in_week = (F.col("review_date") >= clock.day(first)) & (F.col("review_date") < clock.day(last)) & (F.col("total_reviews") > 0)
    sums = ["total_reviews", "rated", "rating_sum", *STARS.values()]
    days = states.groupingSets([["place_name", "review_date"], ["review_date"]], "place_name", "review_date").agg(
        F.grouping("place_name").alias("_all"), *[F.sum(c).alias(c) for c in sums])
    kept = days.filter((F.col("_all") == 1) | F.col("place_name").isNotNull())
    packed = kept.groupBy("_all", "place_name").agg(
        *[F.sum(c).alias(c) for c in sums], F.min(F.when(in_week, F.col("review_date"))).alias("first_day"),
        F.map_from_entries(F.collect_list(F.when(in_week, F.struct("review_date", F.struct(*sums))))).alias("by_day"))
    laid = packed.withColumn("day", F.explode_outer(F.sequence("first_day", F.date_add("first_day", 6))))
    d = laid.withColumn("d", F.try_element_at("by_day", F.col("day")))
    return d.select(
        "place_name", "total_reviews", F.round(F.try_divide("rating_sum", "rated"), 4).alias("average_rating"), *STARS.values(),
        F.col("day").alias("review_date"), F.coalesce("d.total_reviews", F.lit(0)).alias("day_reviews"),
        F.round(F.try_divide(F.col("d.rating_sum"), F.col("d.rated")), 4).alias("day_average"))


# --- wording ---

# The report's paragraphs, as its readers know them.
DISTRIBUTION_TEXT = (
    "Rating Distribution Insights for %s:\n\n"
    "1. %d stars is the most common rating (%d of %d reviews).\n\n"
    "2. High ratings (4-5 stars): %.1f%% of all reviews.\n\n"
    "3. Low ratings (1-2 stars): %.1f%% of all reviews.")
TREND_TEXT = (
    "Daily Review Trend Insights for %s:\n\n"
    "1. The highest number of reviews (%d) occurred on %s, with an average rating of %s stars.\n\n"
    "2. The lowest number of reviews (%d) occurred on %s, with an average rating of %s stars.\n\n"
    "3. Overall, the daily average ratings fluctuated, reaching a low of %s stars and peaking at %s stars.")
COMPARISON_HEAD = "Weekly Comparison Trend Insights for %s:\n\n"
COUNT_TEXT = {"up": "1. Number of reviews increased from %d to %d.\n\n",
              "down": "1. Number of reviews decreased from %d to %d.\n\n",
              "same": "1. Number of reviews remained the same at %d.\n\n"}
AVERAGE_TEXT = {"up": "2. Average rating increased from %s to %s.\n\n",
                "down": "2. Average rating decreased from %s to %s.\n\n",
                "same": "2. Average rating remained the same at %s.\n\n"}
VERDICT_TEXT = {
    "improved": "3. Both the number of reviews and the average rating increased, "
                "indicating improved customer satisfaction.",
    "dropped": "3. Both the number of reviews and the average rating decreased, "
               "indicating a potential drop in customer satisfaction.",
    "more reviews, lower rating": "3. The number of reviews increased, but the average rating decreased, "
                                  "suggesting more reviews but with lower satisfaction.",
    "fewer reviews, higher rating": "3. The number of reviews decreased, but the average rating increased, "
                                    "indicating fewer reviews but improved satisfaction.",
    "no significant change": "3. There is no significant change in both the number of reviews "
                             "and the average rating."}


def _fixed(value: Column, digits: int) -> Column:
    """A mean with fixed digits; a missing one prints as ``nan``."""
    return F.when(value.isNull(), "nan").otherwise(F.format_string(f"%.{digits}f", F.round(value, digits)))


def _pick(key: Column, texts: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for name, text in texts.items():
        out = F.when(key == name, text).otherwise(out)
    return out


def report_text(insights: DataFrame, extremes: DataFrame, comparison: DataFrame) -> DataFrame:
    """The three paragraphs per place, for places with reviews in the current week. Means are rounded here only, so
    the extremes and the comparison should carry raw ones (``digits=None``)."""
    c = F.col
    dist = F.format_string(DISTRIBUTION_TEXT, c("place_name"), c("most_common_rating"), c("most_common_count"),
                           c("total_reviews"), c("high_percent"), c("low_percent"))
    when = lambda d: F.date_format(d, "dd MMM")
    trend = F.format_string(
        TREND_TEXT, c("place_name"), c("most_count"), when("most_date"), _fixed(c("most_average"), 1),
        c("least_count"), when("least_date"), _fixed(c("least_average"), 1),
        _fixed(c("lowest_average"), 1), _fixed(c("highest_average"), 1))
    before, now = c("previous_count"), c("current_count")
    mean_before, mean_now = _fixed(c("previous_average"), 2), _fixed(c("current_average"), 2)
    counts = {m: F.format_string(t, before) if m == "same" else F.format_string(t, before, now)
              for m, t in COUNT_TEXT.items()}
    means = {m: F.format_string(t, mean_before) if m == "same" else F.format_string(t, mean_before, mean_now)
             for m, t in AVERAGE_TEXT.items()}
    weeks = F.concat(F.format_string(COMPARISON_HEAD, c("place_name")), _pick(c("count_change"), counts),
                     _pick(c("average_change"), means), _pick(c("verdict"), {k: F.lit(v) for k, v in VERDICT_TEXT.items()}))
    return (insights.join(extremes, "place_name").join(comparison, "place_name")
            .select("place_name", dist.alias("distribution_text"), trend.alias("trend_text"),
                    weeks.alias("comparison_text")))
