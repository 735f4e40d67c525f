"""Daily summary per place and its messages."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuelens.functions import clock
from venuelens.operators.ingest import alert_fanout
from venuelens.sources.tables import DAILY_SUMMARY

STARS = {5: "five_star_reviews", 4: "four_star_reviews", 3: "three_star_reviews",
         2: "two_star_reviews", 1: "one_star_reviews"}


def daily_window_rows(reviews: DataFrame, as_of: datetime) -> DataFrame:
    return reviews.filter(clock.between(F.col("review_datetime_utc"), *clock.daily_bounds(as_of)))


def star_counts() -> list:
    return [F.sum(F.when(F.col("review_rating") == s, 1).otherwise(0)).alias(c) for s, c in STARS.items()]


def daily_summary(reviews: DataFrame, places: DataFrame, as_of: datetime) -> DataFrame:
    """Every place has a row: without reviews the count and average are 0, the star sums null."""
    day = daily_window_rows(reviews, as_of).groupBy("place_name").agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.round(F.avg("review_rating"), 1).cast("decimal(3,1)").alias("average_rating"), *star_counts())
    return places.select("place_name").join(day, "place_name", "left").select(
        "place_name", F.coalesce("total_reviews", F.lit(0)).alias("total_reviews"),
        F.coalesce("average_rating", F.lit(0).cast("decimal(3,1)")).alias("average_rating"),
        *STARS.values())


def summary_due(places: DataFrame, sent_log: DataFrame, as_of: datetime, kind: str = DAILY_SUMMARY) -> DataFrame:
    done = sent_log.filter((F.col("notification_type") == kind)
                           & (F.col("sent_date") == clock.day(as_of.date()))).select("place_name")
    return places.join(done, "place_name", "left_anti")


def summary_messages(summary: DataFrame, recipients: DataFrame, as_of: datetime) -> DataFrame:
    label = f"{as_of - timedelta(days=1):%d %b %Y}"
    shown_avg = F.when(F.col("average_rating") == 0, F.lit("0")).otherwise(F.col("average_rating").cast("string"))
    fields = [F.col("place_name").alias("1"), F.lit(label).alias("2"),
              F.col("total_reviews").cast("string").alias("3"), shown_avg.alias("4")]
    for i, c in enumerate(STARS.values(), start=5):
        fields.append(F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(str(i)))
    made = summary.select("place_name", F.to_json(F.struct(*fields)).alias("variables"))
    return alert_fanout(made, recipients).select("place_name", "phone", "variables")
