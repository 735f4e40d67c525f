"""Incremental ingest, idempotent insert and alerts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuelens.functions import clock
from venuelens.functions.ratings import normalise_questions
from venuelens.functions.text import preview
from venuelens.operators.skew import first_per_key

NO_TEXT = "NO REVIEW WRITTEN"  # fixed value shown for a review without text


def _cutoff(as_of: datetime, hours: int) -> datetime:
    return as_of.replace(microsecond=0) - timedelta(hours=hours)


def fetch_since(raw: DataFrame, as_of: datetime, hours: int = 8) -> DataFrame:
    """Rows strictly after the cut-off, with the time parsed; unreadable times drop out."""
    parsed = raw.withColumn("review_datetime_utc", clock.parse_us(F.col("review_datetime_utc")))
    return parsed.filter(F.col("review_datetime_utc") > clock.ntz(_cutoff(as_of, hours)))


def late_rows(raw: DataFrame, as_of: datetime, hours: int = 8) -> DataFrame:
    """Accepted and too late rows per place."""
    late = F.col("review_datetime_utc") <= clock.ntz(_cutoff(as_of, hours))
    return raw.groupBy("place_name").agg(
        F.count(F.when(~late, 1)).alias("accepted"), F.count(F.when(late, 1)).alias("too_late"))


def insert_new(batch: DataFrame, existing: DataFrame, key: str = "review_id",
               order: str = "arrival") -> DataFrame:
    """Rows of the batch that are new: the first arrival per key, keys not stored yet, and every
    row without a key (which equals nothing). Keyless rows skip the join, so they do not
    gather in one task; of the stored keys only those of the batch go on."""
    known = F.col(key).isNotNull()
    first = first_per_key(batch.filter(known), key, order)
    stored = existing.select(key).join(first.select(key), key, "left_semi").distinct()
    keyed = first.join(stored, key, "left_anti")
    fresh = keyed.select(*batch.columns).unionByName(batch.filter(~known))
    return (fresh.withColumn("review_questions", normalise_questions(F.col("review_questions")))
            .withColumn("author_reviews_count", F.coalesce("author_reviews_count", F.lit(0)))
            .withColumn("author_ratings_count", F.coalesce("author_ratings_count", F.lit(0))))


def alerts_select(new_rows: DataFrame, max_rating: int = 3, min_len: int = 100) -> DataFrame:
    long_text = F.coalesce(F.length("review_text"), F.lit(0)) > min_len
    return new_rows.filter((F.col("review_rating") <= max_rating) | long_text)


def alert_fanout(alerts: DataFrame, recipients: DataFrame) -> DataFrame:
    """One row per alert and phone; a place without phones gives none."""
    phones = recipients.select("place_name", F.explode("phones").alias("phone"))
    return alerts.join(phones, "place_name")


def with_place_title(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """Rows with the ``title`` of their place, looked up by ``google_id`` in (google_id, title). An id that is not in
    the list, or none, gives no row; of several titles of an id the first in order counts."""
    one = titles.filter(F.col("google_id").isNotNull()).groupBy("google_id").agg(F.min("title").alias("title"))
    return rows.join(one, "google_id")


def alert_chain(raw: DataFrame, stored: DataFrame, recipients: DataFrame, as_of: datetime,
                hours: int = 8) -> tuple[DataFrame, DataFrame]:
    """One batch run: the new reviews among those since the cut-off, and the alert messages of these alone. Write the
    first before the second, or run again: a review that is stored alerts nobody."""
    fresh = insert_new(fetch_since(raw, as_of, hours), stored)
    return fresh, alert_messages(alerts_select(fresh), recipients)


def alert_messages(alerts: DataFrame, recipients: DataFrame, text_limit: int = 200) -> DataFrame:
    """Message variables per alert and phone. The reply text (7) is left to a later model run."""
    text = preview(F.col("review_text"), text_limit, NO_TEXT)
    shown = F.date_format(clock.ist(F.col("review_datetime_utc")), "HH:mm")
    made = alerts.select("review_id", "place_name", F.to_json(F.struct(
        F.col("author_title").alias("1"),
        F.concat(F.col("review_rating").cast("string"), F.lit(" star")).alias("2"),
        shown.alias("3"), text.alias("4"), F.col("review_link").alias("5"),
        F.col("place_name").alias("6")), {"ignoreNullFields": "false"}).alias("variables"))
    return alert_fanout(made, recipients).select("review_id", "place_name", "phone", "variables")
