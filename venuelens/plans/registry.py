"""Every registered query: the job over the views of one data folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuelens.functions import clock
from venuelens.functions.text import preview
from venuelens.operators import chat, ingest, lookup, report, retrieval, sales, summary, themes
from venuelens.session import fresh_path, spread
from venuelens.sources import tables as tb
from venuelens.sources import views as v
from venuelens.streaming import jobs

AS_OF = datetime(2024, 1, 24, 9, 0, 0)
AS_OF_TEXT = datetime(2024, 1, 5, 10, 0, 0)  # the review texts lie in the first days of the data
P0, P1 = date(1998, 1, 1), date(1999, 1, 1)
M0, M1 = date(1998, 1, 1), date(1998, 2, 1)
F0, F1 = date(2024, 1, 5), date(2024, 1, 25)
BASE_URL = "https://reports.example/weekly"
REPLY_PROMPT = "Reply kindly to {author_title}, who gave {review_rating} stars and wrote: {review_text}"

SUMMARY_PROMPT = ("Summarise these {polarity} reviews of {place_name} in two hundred words at most, from the reviews alone; "
                  "without any, answer: No reviews available.\n{joined_text}")
ANSWER_PROMPT = "Answer from the reviews below and nothing else.\nQuestion: {question}\nReviews:\n{context}"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def _week(s, d, text=False, as_of=AS_OF):
    return report.current_week(v.reviews(s, d, text), as_of)


# --- sources, sinks, state ---

@query
def reviews_scan(s, d):
    return tb.reviews_scan(v.reviews(s, d))


@query
def reviews_incremental(s, d):
    return ingest.fetch_since(v.raw_reviews(s, d), AS_OF).drop("sentiment_score")


@query
def reviews_insert_new(s, d):
    batch = ingest.fetch_since(v.raw_reviews(s, d), AS_OF_TEXT, hours=72)
    stored = v.reviews(s, d, text=False).filter(
        F.col("review_datetime_utc") <= clock.ntz(AS_OF_TEXT - timedelta(hours=24)))
    return ingest.insert_new(batch, stored).drop("sentiment_score")


@query
def sent_log_append(s, d):
    places = v.place_dim(s, d)
    log = v.sent_log(s, d, tb.DAILY_SUMMARY, AS_OF.date())
    sent = ingest.alert_fanout(summary.summary_due(places, log, AS_OF), v.recipients(s, d)).select(
        "place_name", F.lit(tb.DAILY_SUMMARY).alias("notification_type"), F.lit(AS_OF.date()).alias("sent_date"))
    return tb.log_sent(log, sent)


@query
def report_state_upsert(s, d):
    done = report.report_due(v.place_dim(s, d), v.report_state(s, d, tb.WEEKLY_REPORT), AS_OF).select(
        "place_name", F.lit(tb.WEEKLY_REPORT).alias("report_type"), F.lit(AS_OF.date()).alias("last_report_date"))
    return tb.upsert_state(v.report_state(s, d, tb.WEEKLY_REPORT), done, ["place_name", "report_type"])


@query
def pos_tables_counts(s, d):
    return tb.pos_tables_counts(v.pos(s, d))


@query
def report_artifacts(s, d):
    return tb.report_artifacts(v.place_dim(s, d).withColumn(
        "place_name", F.concat(F.lit("The "), "place_name")), AS_OF, BASE_URL)


@query
def vectors_scan(s, d):
    return v.vectors(s, d).select("id", "page_content", "rating", "day", F.size("embedding").alias("dims"))


@query
def places_distinct(s, d):
    return tb.places(v.reviews(s, d, text=False))


# --- filters ---

@query
def alerts_select(s, d):
    return ingest.alerts_select(v.reviews(s, d)).select(
        "review_id", "place_name", "review_rating", F.length("review_text").alias("text_length"))


@query
def daily_window_rows(s, d):
    return summary.daily_window_rows(v.reviews(s, d, text=False), AS_OF).select(
        "review_id", "place_name", "review_rating", "review_datetime_utc")


@query
def place_match_regex(s, d):
    return report.place_match_regex(v.reviews(s, d, text=False), "(CL|V)I").select("review_id", "place_name")


@query
def week_assign(s, d):
    return report.week_assign(v.reviews(s, d, text=False), AS_OF).select(
        "review_id", "place_name", "week", "review_date")


@query
def polarity_split(s, d):
    return report.polarity_split(v.reviews(s, d)).select("review_id", "place_name", "polarity", "review_text")


@query
def retrieval_filter(s, d):
    return retrieval.retrieval_filter(v.vectors(s, d), v.requests(s, d))


@query
def sales_period(s, d):
    return sales.sales_period(v.itemwise(s, d), P0, P1).select(
        "item_name", "rate", "qty", "total_amount", "classification", "restaurant_name", "menu_name", "date")


@query
def chat_authorised(s, d):
    return chat.chat_authorised(v.messages(s, d), v.users(s, d))


@query
def chat_refused(s, d):
    return chat.chat_refused(v.messages(s, d), v.users(s, d))


# --- alerts and summary ---

@query
def alert_fanout(s, d):
    return ingest.alert_fanout(ingest.alerts_select(v.reviews(s, d)), v.recipients(s, d)).select(
        "review_id", "place_name", "phone")


@query
def alert_messages(s, d):
    return ingest.alert_messages(ingest.alerts_select(v.reviews(s, d)), v.recipients(s, d))


@query
def place_title_alerts(s, d):
    return ingest.with_place_title(ingest.alerts_select(v.reviews(s, d)), v.place_titles(s, d)).select(
        "review_id", "google_id", "title")


@query
def alert_chain(s, d):
    stored = v.reviews(s, d, text=False).filter(
        F.col("review_datetime_utc") <= clock.ntz(AS_OF_TEXT - timedelta(hours=24)))
    return ingest.alert_chain(v.raw_reviews(s, d), stored, v.recipients(s, d), AS_OF_TEXT, hours=72)[1]


@query
def daily_summary(s, d):
    return summary.daily_summary(v.reviews(s, d, text=False), v.place_dim(s, d), AS_OF)


@query
def summary_due(s, d):
    return summary.summary_due(v.place_dim(s, d), v.sent_log(s, d, tb.DAILY_SUMMARY, AS_OF.date()), AS_OF)


@query
def summary_messages(s, d):
    due = daily_summary(s, d).join(summary_due(s, d), "place_name", "left_semi")
    return summary.summary_messages(due, v.recipients(s, d), AS_OF)


# --- weekly report ---

@query
def report_due(s, d):
    return report.report_due(v.place_dim(s, d), v.report_state(s, d, tb.WEEKLY_REPORT), AS_OF)


@query
def place_reviews_theta(s, d):
    return report.place_reviews_theta(v.reviews(s, d, text=False), v.patterns(s, d), match="regex").select(
        "pattern", "place_name", "review_id")


@query
def report_insights(s, d):
    return report.report_insights(_week(s, d))


@query
def rating_distribution(s, d):
    return report.rating_distribution(_week(s, d))


@query
def top_authors(s, d):
    return report.top_authors(_week(s, d))


@query
def distribution_insights(s, d):
    return report.distribution_insights(rating_distribution(s, d))


@query
def trend_daily(s, d):
    return report.trend_daily(_week(s, d))


@query
def trend_extremes(s, d):
    return report.trend_extremes(trend_daily(s, d))


@query
def week_comparison(s, d):
    return report.week_comparison(v.reviews(s, d, text=False), AS_OF)


@query
def week_over_week(s, d):
    return report.week_over_week(v.reviews(s, d, text=False))


@query
def historic_average(s, d):
    return report.historic_average(v.reviews(s, d, text=False), AS_OF)


@query
def polarity_text(s, d):
    return report.polarity_text(_week(s, d, True, AS_OF_TEXT), part_size=50)


@query
def distribution_weekly(s, d):
    return report.distribution_weekly(v.reviews(s, d, text=False))


@query
def sentiment_overall(s, d):
    return report.sentiment_overall(v.reviews(s, d, text=False))


@query
def report_text(s, d):
    extremes = report.trend_extremes(report.trend_daily(_week(s, d), digits=None))
    comparison = report.week_comparison(v.reviews(s, d, text=False), AS_OF, digits=None)
    return report.report_text(distribution_insights(s, d), extremes, comparison)


@query
def dashboard_metrics(s, d):
    return report.dashboard_metrics(v.reviews(s, d, text=False))


@query
def dashboard_trend(s, d):
    return report.dashboard(report.daily_states(v.reviews(s, d, text=False)), AS_OF)


# --- point of sale ---

@query
def top_items(s, d):
    return sales.top_items(v.itemwise(s, d, restaurant=False), P0, P1, n=10)


@query
def top_items_display(s, d):
    return sales.top_items_display(sales.top_items(v.itemwise(s, d, restaurant=False), P0, P1, n=3))


@query
def pipe_rows(s, d):
    return themes.pipe_rows(top_items_display(s, d))


@query
def best_item_by_month(s, d):
    return sales.best_item_by_month(v.itemwise(s, d, restaurant=False))


@query
def sales_weekly_rollup(s, d):
    return sales.sales_weekly_rollup(v.sales_book(s, d), M0, M1)


@query
def category_sales(s, d):
    return sales.category_sales(v.itemwise(s, d, restaurant=False), P0, P1)


@query
def category_sales_book(s, d):
    return sales.category_sales_book(v.sales_book(s, d), P0, P1)


@query
def footfall_daily(s, d):
    return sales.footfall_daily(v.footfall(s, d), F0, F1)


@query
def footfall_by_source(s, d):
    return sales.footfall_by_source(v.footfall(s, d), F0, F1)


@query
def seating_delay(s, d):
    return sales.seating_delay(v.footfall(s, d))


@query
def seating_delay_percentiles(s, d):
    return sales.seating_delay_percentiles(sales.seating_delay_days(v.footfall(s, d)), F0, F1)


@query
def issue_by_department(s, d):
    return sales.issue_by_department(v.issue(s, d), P0, P1)


@query
def kot_items(s, d):
    return sales.kot_items(v.kot(s, d), P0, P1)


@query
def kot_hourly(s, d):
    return sales.kot_hourly(v.kot(s, d))


@query
def kot_tables(s, d):
    return sales.kot_tables(v.kot(s, d))


@query
def kot_bill_items(s, d):
    bills = v.sales_book(s, d).filter(F.col("gross_amount") > 400000)
    return sales.kot_bill_items(v.kot(s, d), bills)


@query
def financial_summary(s, d):
    return sales.financial_summary(v.sales_book(s, d), P0, P1)


@query
def item_averages(s, d):
    return sales.item_averages(v.itemwise(s, d, restaurant=False), P0, P1)


@query
def payment_mix(s, d):
    return sales.payment_mix(v.sales_book(s, d), P0, P1)


@query
def low_star_reviews(s, d):
    return sales.low_star_reviews(v.chat_reviews(s, d), F0, F1).drop("review")


@query
def review_counts(s, d):
    return sales.review_counts(v.chat_reviews(s, d), F0, F1)


# --- text, lookup, retrieval ---

@query
def key_phrases(s, d):
    return themes.key_phrases(_week(s, d, True, AS_OF_TEXT))


@query
def review_digest(s, d):
    return themes.review_digest(_week(s, d, True, AS_OF_TEXT))


@query
def prompt_batch(s, d):
    alerts = ingest.alerts_select(v.reviews(s, d)).withColumn(
        "review_text", preview(F.col("review_text"), 200, ingest.NO_TEXT))
    return themes.prompt_batch(alerts, REPLY_PROMPT).select("review_id", "prompt")


@query
def summary_prompts(s, d):
    parts = report.polarity_text(_week(s, d, True, AS_OF_TEXT), part_size=50)
    return themes.prompt_batch(parts, SUMMARY_PROMPT).select("place_name", "polarity", "part_no", "prompt")


@query
def answer_prompts(s, d):
    asked = v.requests(s, d).select("request_id", "question")
    found = answer_context(s, d).join(asked, "request_id")
    return themes.prompt_batch(found, ANSWER_PROMPT).select("request_id", "prompt")


@query
def request_parse(s, d):
    return themes.request_parse(themes.request_text(v.requests(s, d))).select(
        "request_id", "question", F.array_join(F.col("ratings").cast("array<string>"), ",").alias("ratings"),
        F.array_join("dates", ",").alias("dates"))


@query
def vocabulary(s, d):
    return lookup.vocabulary(v.issue(s, d), v.footfall(s, d), v.itemwise(s, d, restaurant=False))


@query
def value_lookup(s, d):
    return lookup.value_lookup(v.misspelt_terms(s, d), vocabulary(s, d)).withColumn("jaccard", F.round("jaccard", 6))


@query
def value_lookup_lsh(s, d):
    # the name is that of an earlier, approximate form
    return lookup.value_lookup_join(v.misspelt_terms(s, d), vocabulary(s, d)).withColumn("jaccard", F.round("jaccard", 6))


@query
def knn_filtered(s, d):
    return retrieval.knn_filtered(v.requests(s, d), v.vectors(s, d))


@query
def knn_lsh(s, d):
    # the name is that of an earlier, approximate form
    return retrieval.knn_ivf(v.requests(s, d), v.vectors(s, d))


@query
def answer_context(s, d):
    return retrieval.answer_context(knn_filtered(s, d))


@query
def text_vectors(s, d):
    made = retrieval.text_vectors(spread(v.table(s, d, "documents").select("doc_id", "text"), "doc_id"))
    flat = F.unwrap_udt("features")
    return made.select("doc_id", flat["indices"].alias("indices"), flat["values"].alias("weights"))


@query
def similar_questions(s, d):
    said = v.table(s, d, "conversations").filter(F.col("role") == "user").withColumn(
        "question_id", F.col("conv_id") * 1000 + F.col("turn"))
    stored = said.filter(F.col("turn") == 0).select(
        "question_id", "text", F.concat(F.lit("query "), F.col("question_id").cast("string")).alias("query"))
    return retrieval.similar_questions(said.filter(F.col("turn") > 0).select("question_id", "text"), stored)


# --- chat ---

@query
def chat_routing(s, d):
    return chat.chat_routing(v.messages(s, d))


@query
def chat_intent_counts(s, d):
    return chat.chat_intent_counts(chat_routing(s, d))


@query
def chat_history(s, d):
    return chat.chat_history(v.messages(s, d))


@query
def chat_latest_user(s, d):
    return chat.chat_latest_user(v.messages(s, d))


@query
def message_tables(s, d):
    return chat.message_tables(v.messages(s, d))


@query
def message_tables_loose(s, d):
    return chat.message_tables(v.messages(s, d), strict=False)


@query
def message_descriptions(s, d):
    return chat.message_descriptions(v.messages(s, d))


@query
def result_pages(s, d):
    rows = sales.low_star_reviews(v.chat_reviews(s, d), F0, F1).select("time", "review_no", "rating", "dining")
    return chat.result_pages(rows, ["time", "review_no"])


# --- streams, replayed over the whole table ---

@query
def late_rows(s, d):
    return ingest.late_rows(v.reviews(s, d, text=False), AS_OF)


def _stream_reviews(s, d, text=False):
    events = v.stream_table(s, d, "events")
    if text:
        docs = v.table(s, d, "documents").select(F.col("doc_id").alias("event_id"), "text")
        events = events.join(docs, "event_id", "left")
    return v.shape_reviews(events)


def _run(q) -> None:
    q.awaitTermination()


@query
def stream_ingest(s, d):
    sink, mark = fresh_path(s, "reviews"), fresh_path(s, "ingest-mark")
    _run(jobs.stream_ingest(v.feed(_stream_reviews(s, d, True)), sink, mark))
    return s.read.parquet(sink).drop("batch_id", "sentiment_score")


@query
def stream_alerts(s, d):
    sink, out, mark = fresh_path(s, "reviews"), fresh_path(s, "alerts"), fresh_path(s, "alerts-mark")
    _run(jobs.stream_alerts(v.feed(_stream_reviews(s, d, True)), sink, out, v.recipients(s, d), mark))
    return s.read.parquet(out).drop("batch_id")


@query
def stream_daily_summary(s, d):
    sink, mark = fresh_path(s, "daily"), fresh_path(s, "daily-mark")
    _run(jobs.stream_daily_summary(_stream_reviews(s, d), sink, mark))
    return s.read.parquet(sink)


@query
def stream_weekly(s, d):
    sink, mark = fresh_path(s, "weekly"), fresh_path(s, "weekly-mark")
    _run(jobs.stream_weekly(_stream_reviews(s, d), sink, mark))
    return s.read.parquet(sink)


@query
def stream_chat(s, d):
    sink, mark = fresh_path(s, "chat"), fresh_path(s, "chat-mark")
    _run(jobs.stream_chat(v.shape_messages(v.stream_table(s, d, "conversations")), sink, mark))
    return s.read.parquet(f"{sink}/out").drop("batch_id")
