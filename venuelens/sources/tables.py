"""Readers with fixed schemas, report sink, logs and state tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW_SCHEMA = (
    "place_name string, google_id string, review_id string, author_title string, "
    "author_id string, review_text string, review_questions string, review_link string, "
    "review_rating int, review_datetime_utc timestamp_ntz, author_reviews_count int, "
    "author_ratings_count int, sentiment_score double"
)
REPORT_COLUMNS = [
    "place_name", "google_id", "review_id", "author_title", "author_id", "review_text",
    "review_questions", "review_link", "review_rating", "review_datetime_utc", "sentiment_score",
]
SENT_SCHEMA = "place_name string, notification_type string, sent_date date"
STATE_SCHEMA = "place_name string, report_type string, last_report_date date"
VECTOR_SCHEMA = "id bigint, page_content string, rating int, day date, embedding array<float>"
# The kinds stored in the log and the state table.
DAILY_SUMMARY = "GoogleReviewsDailySummary"
WEEKLY_REPORT = "customer_review_report_weekly"

POS_SCHEMAS = {
    "footfall": "sno bigint, booking_time timestamp_ntz, seated_time timestamp_ntz, "
                "reserved_time timestamp_ntz, booking_type string, guest_name string, "
                "guest_email string, pax int, sections string, tables string, visit_count int, "
                "booking_status string, deletion_type string, source_of_booking string",
    "issue": "item_name string, units string, issue_name string, amount decimal(18,2), "
             "rate decimal(18,2), quantity decimal(18,3), date date",
    "itemwise": "item_name string, rate decimal(18,2), qty decimal(18,3), "
                "total_amount decimal(18,2), classification string, restaurant_name string, "
                "menu_name string, date date",
    "kot": "kot bigint, kot_time timestamp_ntz, table_number int, item_name string, "
           "rate decimal(18,2), quantity decimal(18,3), total_amount decimal(18,2), "
           "bill_number bigint, restaurant_name string, classification string, type string, "
           "class_name string, date date",
    "chat_reviews": "rating int, review string, dining string, time timestamp_ntz",
    "sales_book": "bill_date date, bill_number bigint, table_number int, pax int, "
                  "gross_amount decimal(18,2), cash decimal(18,2), credit_card decimal(18,2), "
                  "company decimal(18,2), food decimal(18,2), liquor decimal(18,2), "
                  "soft_drinks decimal(18,2), beer decimal(18,2), wine decimal(18,2), "
                  "time timestamp_ntz, extracted_date date, smokes decimal(18,2)",
}

# Source spellings of the point-of-sale columns that plain snake case does not give.
POS_RENAMES = {
    "section(s)": "sections", "table(s)": "tables", "vist_count": "visit_count",
    "itemname": "item_name", "totalamount": "total_amount",
    "restaurantname": "restaurant_name", "menuname": "menu_name",
}


def _read(spark: SparkSession, path: str, schema: str, fmt: str, options: dict) -> DataFrame:
    if fmt == "jdbc":
        return spark.read.format("jdbc").options(dbtable=path, **options).load()
    return spark.read.schema(schema).format(fmt).options(**options).load(path)


def read_reviews(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return _read(spark, path, REVIEW_SCHEMA, fmt, options).select(*REPORT_COLUMNS)


def reviews_scan(reviews: DataFrame) -> DataFrame:
    return reviews.select(*REPORT_COLUMNS)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors stored in partitions by ``day``, so that a day filter prunes folders."""
    return _read(spark, path, VECTOR_SCHEMA, "parquet", {})


def snake_case(df: DataFrame) -> DataFrame:
    names = {}
    for c in df.columns:
        low = c.strip().lower().replace(" ", "_")
        names[c] = POS_RENAMES.get(low, low)
    return df.withColumnsRenamed(names)


def load_pos(spark: SparkSession, root: str, fmt: str = "parquet", **options) -> dict[str, DataFrame]:
    """The six point-of-sale tables below ``root``, with snake-case names and fixed types."""
    out = {}
    for name, schema in POS_SCHEMAS.items():
        raw = snake_case(spark.read.format(fmt).options(**options).load(f"{root}/{name}"))
        typed = spark.createDataFrame([], schema).schema
        out[name] = raw.select(*[F.col(f.name).cast(f.dataType) for f in typed])
    return out


def pos_tables_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count(F.lit(1)).alias("row_count"))
              .select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def places(reviews: DataFrame) -> DataFrame:
    return reviews.select("place_name").filter(F.col("place_name").isNotNull()).distinct()


def log_sent(log: DataFrame, sent: DataFrame) -> DataFrame:
    """The log with one appended row per message that went out."""
    return log.unionByName(sent.select(*log.columns))


def append_sent(sent: DataFrame, path: str) -> None:
    sent.write.mode("append").parquet(path)


def upsert_state(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Matched keys take the source row, others are inserted. A partial aggregate per key,
    so neither side is sorted or joined. A null key never matches and is kept as a row."""
    rest = [c for c in target.columns if c not in keys]
    both = (target.withColumn("_rank", F.lit(0))
            .unionByName(source.select(*target.columns).withColumn("_rank", F.lit(1))))
    some_null = F.lit(False)
    for key in keys:
        some_null = some_null | F.col(key).isNull()
    merged = (both.filter(~some_null).groupBy(*keys)
              .agg(F.max(F.struct("_rank", *rest)).alias("_row"))
              .select(*keys, *[F.col(f"_row.{c}") for c in rest]))
    return merged.select(*target.columns).unionByName(both.filter(some_null).select(*target.columns))


def save_state(df: DataFrame, root: str, version: int) -> None:
    """A new version folder; the version being read is never overwritten."""
    df.write.mode("overwrite").parquet(f"{root}/version={version:010d}")


def read_state(spark: SparkSession, root: str) -> DataFrame:
    df = spark.read.parquet(root)
    newest = df.agg(F.max("version")).first()[0]
    return df.filter(F.col("version") == newest).drop("version")


def report_artifacts(place_list: DataFrame, as_of: datetime, base_url: str) -> DataFrame:
    name = F.concat(F.col("place_name"), F.lit(f"_weekly_report_{as_of:%Y%m%d}.pdf"))
    link_name = F.replace(name, F.lit(" "), F.lit("%20"))
    return place_list.select(
        "place_name", name.alias("artifact_name"),
        F.concat(F.lit(base_url.rstrip("/") + "/"), link_name).alias("artifact_url"),
        F.to_json(F.struct(F.col("place_name").alias("1"), link_name.alias("2"))).alias("variables"))


def write_report(df: DataFrame, path: str, report_date: date) -> None:
    """One folder per place and date; only the folders present in ``df`` are replaced."""
    (df.withColumn("report_date", F.lit(report_date))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("place_name", "report_date").parquet(path))
