"""Hand-made edge rows for the rules of each job."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from venuelens.functions import clock, text
from venuelens.plans import registry
from venuelens.operators import chat, ingest, report, retrieval, sales, summary, themes
from venuelens.sources import tables as tb

AS_OF = datetime(2024, 1, 24, 9, 0)
DEFAULTS = dict(place_name="A", google_id="g", review_id="1", author_title="Ann", author_id="1", review_text="ok",
                review_questions="{}", review_link="http://x", review_rating=5,
                review_datetime_utc=datetime(2024, 1, 23, 12), author_reviews_count=1, author_ratings_count=1,
                sentiment_score=0.5)


def reviews(spark, *rows):
    cols = [c.split()[0] for c in tb.REVIEW_SCHEMA.split(", ")]
    made = [{**DEFAULTS, **r} for r in rows]
    return spark.createDataFrame([tuple(m[c] for c in cols) for m in made], tb.REVIEW_SCHEMA)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_alert_rule(spark):
    df = reviews(spark, *[dict(review_id=f"{r}-{n}", review_rating=r, review_text=t) for r in (3, 4)
                          for n, t in (("null", None), ("empty", ""), ("100", "x" * 100), ("101", "x" * 101))])
    got = {r.review_id for r in ingest.alerts_select(df).collect()}
    assert got == {"3-null", "3-empty", "3-100", "3-101", "4-101"}


def test_alert_message_text_and_time(spark):
    phones = spark.createDataFrame([("A", ["p1", "p2"])], "place_name string, phones array<string>")
    df = reviews(spark, dict(review_id="crlf", review_text="a\r\nb", review_datetime_utc=datetime(2024, 1, 1, 18, 45)),
                 dict(review_id="cut", review_text="y" * 199 + "\nz"), dict(review_id="none", review_text=None, author_title=None),
                 dict(review_id="other", place_name="B"))
    got = {}
    for r in ingest.alert_messages(df, phones).collect():
        got.setdefault(r.review_id, []).append(json.loads(r.variables))
    assert {k: len(v) for k, v in got.items()} == {"crlf": 2, "cut": 2, "none": 2}
    assert got["crlf"][0]["4"] == "a  b" and got["crlf"][0]["3"] == "00:15" and got["crlf"][0]["2"] == "5 star"
    assert got["cut"][0]["4"] == "y" * 199 + " "
    assert got["none"][0]["4"] == "NO REVIEW WRITTEN" and got["none"][0]["1"] is None


def test_fetch_and_insert(spark):
    raw = reviews(spark, dict(review_id="a"), dict(review_id="a", review_text="later"), dict(review_id="b"),
                  dict(review_id=None), dict(review_id=None), dict(review_id="q", review_questions="None"))
    raw = raw.coalesce(1).withColumn("arrival", F.monotonically_increasing_id())
    stored = reviews(spark, dict(review_id="b"), dict(review_id=None))
    new = ingest.insert_new(raw, stored)
    assert rows(new, "review_id", "review_text", "review_questions") == rows(spark.createDataFrame(
        [("a", "ok", "{}"), (None, "ok", "{}"), (None, "ok", "{}"), ("q", "ok", "{}")], "i string, t string, q string"), "i", "t", "q")
    again = ingest.insert_new(new, stored.unionByName(new.select(stored.columns)))
    assert {r.review_id for r in again.collect()} == {None}
    feed = spark.createDataFrame([("1/24/2024 1:00:00",), ("1/24/2024 1:00:01",), ("01/24/2024 09:05:00",), ("junk",), (None,)],
                                 "review_datetime_utc string")
    assert ingest.fetch_since(feed, AS_OF.replace(microsecond=5)).count() == 2


def test_daily_window_edges(spark):
    edge = lambda d, *t: datetime(2024, 1, d, *t)
    df = reviews(spark, dict(review_id="before", review_datetime_utc=edge(22, 18, 29, 59, 999999), review_rating=1),
                 dict(review_id="first", review_datetime_utc=edge(22, 18, 30), review_rating=2),
                 dict(review_id="last", review_datetime_utc=edge(23, 18, 29, 59, 999999), review_rating=5),
                 dict(review_id="after", review_datetime_utc=edge(23, 18, 30)))
    places = spark.createDataFrame([("A",), ("Empty",)], "place_name string")
    got = {r.place_name: r for r in summary.daily_summary(df, places, AS_OF).collect()}
    assert (got["A"].total_reviews, float(got["A"].average_rating), got["A"].two_star_reviews) == (2, 3.5, 1)
    assert got["Empty"].total_reviews == 0 and float(got["Empty"].average_rating) == 0 and got["Empty"].five_star_reviews is None
    phones = spark.createDataFrame([("Empty", ["p"])], "place_name string, phones array<string>")
    sent = json.loads(summary.summary_messages(summary.daily_summary(df, places, AS_OF), phones, AS_OF).first().variables)
    assert sent["2"] == "23 Jan 2024" and sent["4"] == "0" and sent["5"] == "None"
    # after 18:30 UTC the window is the day before the local yesterday
    assert clock.daily_bounds(datetime(2024, 1, 24, 19))[1] == datetime(2024, 1, 23, 18, 30)


def test_week_edges(spark):
    times = {"p0": (9, 18, 29, 59, 999999), "p1": (9, 18, 30), "p2": (16, 18, 29, 59, 999999), "c1": (16, 18, 30),
             "c2": (23, 18, 29, 59, 999999), "c3": (23, 18, 30)}
    df = reviews(spark, *[dict(review_id=k, review_datetime_utc=datetime(2024, 1, *t)) for k, t in times.items()])
    assert rows(report.week_assign(df, AS_OF), "review_id", "week") == [
        ("c1", "current"), ("c2", "current"), ("p1", "previous"), ("p2", "previous")]


def test_sub_ratings(spark):
    texts = ["{}", "{'Food': 4}", "{'Food': null}", "{'Food': 'x'}", "broken", None, '{"Food": "3"}']
    df = reviews(spark, *[dict(review_questions=q) for q in texts])
    got = report.report_insights(df).first()
    assert got.food == 3.0 and got.bad_questions == 1 and got.total_reviews == 7
    assert got.service == 5.0  # missing in every readable one


def test_place_match(spark):
    df = reviews(spark, *[dict(place_name=p) for p in ("A", "a plus", "B", None, "Cafe X")])
    assert report.place_match_regex(df, "A").count() == 3
    assert report.place_match_regex(df, "(B|X)").count() == 2
    one = spark.createDataFrame([("A",)], "place_name string")
    assert report.place_reviews_theta(df, one).count() == 1
    assert report.place_reviews_theta(df, one, match="regex").count() == 3


def test_distribution(spark):
    df = reviews(spark, *[dict(review_rating=r) for r in (2, 2, 4, 4, 0, 6, None)])
    dist = report.rating_distribution(df)
    assert rows(dist, "stars_1", "stars_2", "stars_4", "stars_5") == [(0, 2, 2, 0)]
    got = report.distribution_insights(dist).first()
    assert (got.most_common_rating, got.most_common_count, got.total_reviews, got.high_percent, got.low_percent) == (2, 2, 4, 50.0, 50.0)


def test_trend(spark):
    at = lambda d: datetime(2024, 1, d, 10)
    df = reviews(spark, *[dict(review_datetime_utc=at(d), review_rating=r) for d, r in
                          ((18, 5), (18, 1), (20, 4), (20, 6), (22, None))])
    trend = report.trend_daily(report.current_week(df, AS_OF))
    got = {r.review_date.day: (r.total, r.average_rating) for r in trend.collect()}
    assert got == {18: (2, 3.0), 19: (0, None), 20: (2, 5.0), 21: (0, None), 22: (0, None), 23: (0, None), 24: (0, None)}
    ends = report.trend_extremes(trend).first()
    assert (ends.most_date.day, ends.least_date.day, ends.least_average, ends.lowest_average, ends.highest_average) == (18, 19, None, 3.0, 5.0)
    assert report.trend_daily(report.current_week(df.filter("review_rating > 9"), AS_OF)).count() == 0


@pytest.mark.parametrize("before, now, verdict", [
    ([3], [4, 5], "improved"), ([4, 5], [3], "dropped"), ([5], [1, 2], "more reviews, lower rating"),
    ([1, 2], [5], "fewer reviews, higher rating"), ([3], [3], "no significant change"), ([], [4], "no significant change")])
def test_week_comparison(spark, before, now, verdict):
    df = reviews(spark, *[dict(review_rating=r, review_datetime_utc=datetime(2024, 1, 12)) for r in before],
                 *[dict(review_rating=r, review_datetime_utc=datetime(2024, 1, 20)) for r in now])
    got = report.week_comparison(df, AS_OF).first()
    assert (got.verdict, got.previous_count, got.current_count) == (verdict, len(before), len(now))
    if not before:
        assert got.average_change == "same"


def test_report_due(spark):
    places = spark.createDataFrame([("never",), ("sunday",), ("monday",)], "place_name string")
    state = spark.createDataFrame([("sunday", tb.WEEKLY_REPORT, date(2024, 1, 21)), ("monday", tb.WEEKLY_REPORT, date(2024, 1, 22)),
                                   ("never", "other", date(2024, 1, 23))], tb.STATE_SCHEMA)
    assert rows(report.report_due(places, state, AS_OF), "place_name") == [("never",), ("sunday",)]


def test_weekly_rollup(spark):
    day = lambda d, amount: (date(2024, 1, d), amount) + (amount / 2,) * 6
    cols = "bill_date date, gross_amount double, food double, liquor double, soft_drinks double, beer double, wine double, smokes double"
    book = spark.createDataFrame([day(1, 10.0), day(6, 1.0), day(7, 5.0), day(13, 2.0), day(14, 4.0), day(16, 8.0), day(17, 99.0)], cols)
    money = [F.col(c).cast("decimal(18,2)").alias(c) if c != "bill_date" else F.col(c) for c in book.columns]
    got = {r.week: (str(r.week_start), str(r.week_end), float(r.total_sales)) for r in
           sales.sales_weekly_rollup(book.select(money), date(2024, 1, 1), date(2024, 1, 17)).collect()}
    assert got == {"1": ("2024-01-01", "2024-01-06", 11.0), "2": ("2024-01-07", "2024-01-13", 7.0),
                   "3": ("2024-01-14", "2024-01-16", 12.0), "Total": ("None", "None", 30.0)}


def test_rupees_and_pipes(spark):
    df = spark.createDataFrame([("a", "1237257.4"), ("b", "1000"), ("c", "630249"), ("d", "32579055"), ("e", "7")], "item string, x string")
    shown = [r.s for r in df.orderBy("item").select(text.indian_rupees(F.col("x").cast("decimal(18,2)")).alias("s")).collect()]
    assert shown == ["₹12,37,257", "₹1,000", "₹6,30,249", "₹3,25,79,055", "₹7"]
    assert themes.pipe_rows(df.filter("item = 'a'")).first().asDict() == {"header": "item | x", "line": "a | 1237257.4"}


def _messages(spark, *texts, role="user"):
    return spark.createDataFrame([("u", i, role, t) for i, t in enumerate(texts)], "user string, turn long, role string, text string")


@pytest.mark.parametrize("texts, intents", [
    (["Hi!", " HOWDY?! ", "hi there"], ["greeting", "greeting", "question"]),
    (["👎", "it was wrong", "more"], ["feedback_down", "feedback_detail", "question"]),
    (["👎", "thanks", "why"], ["feedback_down", "thanks", "feedback_detail"]),
    (["👎", "👎", "text"], ["feedback_down", "feedback_down", "feedback_detail"]),
    (["👎", "👍", "👍"], ["feedback_down", "feedback_detail", "feedback_up"]),
    (["How's it going?", "what can you do for me"], ["how_are_you", "help"])])
def test_routing(spark, texts, intents):
    got = chat.chat_routing(_messages(spark, *texts)).orderBy("turn").collect()
    assert [r.intent for r in got] == intents


def test_routing_with_a_named_assistant(spark):
    got = chat.chat_routing(_messages(spark, "hello robin!"), assistant_names=["robin"]).first()
    assert got.intent == "greeting"


def test_history_length(spark):
    got = chat.chat_history(_messages(spark, *[f"m{i}" for i in range(8)])).filter("turn = 7").first()
    assert got.messages == 7 and got.history.startswith("User: m1\n") and got.history.endswith("User: m7")
    assert chat.chat_latest_user(_messages(spark, "x", role="assistant")).first().latest_message == ""


def test_history_holds_questions_and_their_answers_only(spark):
    said = [("user", "Hi!"), ("assistant", "Hello, ask away"), ("user", " top items "), ("assistant", "Tea"), ("user", "👎"),
            ("assistant", "What went wrong?"), ("user", "wrong year"), ("assistant", "Noted"), ("user", "👍"), ("assistant", "Thanks"),
            ("assistant", "and more"), ("user", "sales?"), ("assistant", "12"), ("assistant", "13")]
    df = spark.createDataFrame([("u", i, r, t) for i, (r, t) in enumerate(said)], "user string, turn long, role string, text string")
    for block in (3, 10_000):
        got = {r.turn: r.history for r in chat.chat_history(df, block=block).collect()}
        assert sorted(got) == [2, 3, 11, 12, 13]
        assert got[13] == "User: top items\nAI: Tea\nUser: sales?\nAI: 12\nAI: 13"
        assert chat.chat_latest_user(df, block=block).first().latest_message == "sales?"
    many = df.unionByName(spark.createDataFrame([("u", 20 + i, "assistant", "x") for i in range(7)], df.schema))
    assert chat.chat_latest_user(many).first().latest_message == ""


def test_served_places_get_no_summary_and_prompts_show_the_preview(spark):
    sf = "/root/testdata/sf0.001"
    sent = {r.place_name for r in registry.QUERIES["summary_messages"](spark, sf).select("place_name").collect()}
    assert sent == {r.place_name for r in registry.QUERIES["summary_due"](spark, sf).collect()}
    prompts = [r.prompt for r in registry.QUERIES["prompt_batch"](spark, sf).collect()]
    assert any(p.endswith("wrote: NO REVIEW WRITTEN") for p in prompts) and not any("\n" in p for p in prompts)


def test_means_are_rounded_once(spark):
    at = dict(review_datetime_utc=datetime(2024, 1, 17))
    five = [dict(review_id=str(i), review_rating=3 + (i < 79), **at) for i in range(229)] + [
        dict(review_id="p", review_datetime_utc=datetime(2024, 1, 10))]  # 766 stars in the week, five the week before
    df = reviews(spark, *five)
    week = report.current_week(df, AS_OF)
    text = report.report_text(report.distribution_insights(report.rating_distribution(week)),
                              report.trend_extremes(report.trend_daily(week, digits=None)),
                              report.week_comparison(df, AS_OF, digits=None)).first().comparison_text
    assert "3.34" in text and "3.35" not in text


def test_all_places_row_counts_reviews_without_a_place(spark):
    df = reviews(spark, dict(review_id="1"), dict(review_id="2", place_name=None))
    got = {r.place_name: r.total_reviews for r in report.dashboard_metrics(df).collect()}
    assert got[None] == 2 and len(got) == 2


TOTAL = "Sales: \n##| Week | Start | Sales |\n|---|---|---|\n| 1 | 01 | 5 |\n| Total | | 5 |\n##"


def test_message_tables(spark):
    msgs = _messages(spark, TOTAL, "## | A |\n| 1 | ##", "a ##|X|\n|-|\n|1|## b ##|Y|\n|-|\n|2|", role="assistant")
    cells = {(r.turn, r.table_no, r.row_no, r.column_name): r.value for r in chat.message_tables(msgs).collect()}
    assert cells[(0, 0, 1, "Week")] == "Total" and cells[(0, 0, 1, "Start")] == "" and cells[(0, 0, 1, "Sales")] == "5"
    assert {k: v for k, v in cells.items() if k[0] > 0} == {(2, 0, 0, "X"): "1", (2, 1, 0, "Y"): "2"}
    loose = {(r.turn, r.row_no, r.column_name): r.value for r in chat.message_tables(msgs, strict=False).collect()}
    assert loose[(0, 1, "Start")] == "5" and (0, 1, "Sales") not in loose
    assert chat.message_descriptions(msgs).orderBy("turn").first().description == "Sales:"


@pytest.mark.parametrize("n, pages", [(0, 0), (30, 1), (31, 2)])
def test_pages(spark, n, pages):
    df = chat.result_pages(spark.range(n), ["id"])
    got = df.groupBy("page").count().collect()
    assert len(got) == pages and sum(r["count"] for r in got) == n


def test_requests(spark):
    raw = spark.createDataFrame([(1, "Rating:**4,5** Q:$$ how is it $$ D:^^01-01-2024,02-01-2024^^"), (2, "$$ q $$ ^^d^^")],
                                "request_id long, request string")
    got = {r.request_id: r for r in themes.request_parse(raw).collect()}
    assert (got[1].question, got[1].ratings, got[1].dates) == ("how is it", [4, 5], ["01-01-2024", "02-01-2024"])
    assert got[2].question is None and got[2].ratings is None
    asked = spark.createDataFrame([(1, "q", "4, 5", "2024-01-31", "2024-02-01"), (2, "q", "4", "2024-01-02", "2024-01-01")],
                                  "request_id long, question string, rating string, start_date string, end_date string")
    cells = retrieval.request_cells(asked)
    assert rows(cells, "request_id", "rating", "day") == [
        (1, r, d) for r in (4, 5) for d in (date(2024, 1, 31), date(2024, 2, 1))]


def test_digest(spark):
    at = dict(review_datetime_utc=datetime(2024, 1, 20))
    df = reviews(spark, dict(review_id="1", review_text="Great tasty soup. Great service!", review_rating=5, **at),
                 dict(review_id="2", review_text="Great tasty soup\nslow " + "word " * 300, review_rating=4, **at),
                 dict(review_id="3", place_name="B", review_text=None, review_rating=1, **at))
    week = report.current_week(df, AS_OF)
    got = {(r.place_name, r.polarity): r for r in themes.review_digest(week, max_words=4).collect()}
    assert got[("A", "positive")].digest == "Great tasty soup"
    long = reviews(spark, dict(review_id="1", review_text="tasty broth " * 300, review_rating=5, **at))
    cut = {r.polarity: r for r in themes.review_digest(report.current_week(long, AS_OF)).collect()}
    assert cut["positive"].n_words == 200 and cut["positive"].digest.startswith("tasty broth tasty")
    for key in (("A", "negative"), ("B", "positive"), ("B", "negative")):
        assert got[key].digest == themes.NO_REVIEWS and got[key].n_words == 0


def test_prompt(spark):
    df = spark.createDataFrame([("Ann", None)], "name string, x string")
    assert themes.prompt_batch(df, "Dear {name}: {x}!").first().prompt == "Dear Ann: !"


def test_wait_percentiles_come_from_merged_days(spark):
    from datetime import datetime, timedelta
    start = datetime(2024, 1, 5, 23, 50)
    waits = [0, 0, 1, 2, 3, 5, 8, 13, 90, 90]
    rows = [(start + timedelta(days=i % 3), start + timedelta(days=i % 3, minutes=w), "A") for i, w in enumerate(waits)]
    rows += [(start, start + timedelta(seconds=59), "B"), (start, None, "B"), (start, start + timedelta(minutes=4), None), (start - timedelta(days=9), start, "A")]
    days = sales.seating_delay_days(spark.createDataFrame(rows, "booking_time timestamp_ntz, seated_time timestamp_ntz, sections string"))
    got = {r.sections: (r.seated, r.p50, r.p90, r.p99) for r in sales.seating_delay_percentiles(days, date(2024, 1, 5), date(2024, 1, 9)).collect()}
    assert got == {"A": (10, 3, 90, 90), "B": (1, 0, 0, 0), None: (1, 4, 4, 4)}


def test_required_literals():
    known = {"abc": "abc", "^ab.*cde$": "cde", "ab?cd": "cd", "abc*": "ab", "ab+c": "ab", "a{0,2}bc": "bc", "(ab)?cd": "cd",
             "x[a-c]yz": "yz", r"a\.b": "a.b", r"\d\dkm": "km", "ab|cd": "", "(?i)abc": "", r"\x41bc": "", "(a|b)(c)": "", "": "",
             r"(a\)b[)])cde": "cde", ".*": "", "ab{2}cd": "cd", "a*?bc": "bc"}
    assert {p: report.required_literal(p) for p in known} == known


def test_names_meet_the_patterns_they_match(spark):
    names = spark.createDataFrame([(n,) for n in ("Blue Fox", "blue-box", "ÉCLAIR", "éclair 2", "aab", "A.B", "xyz", "", None, "ab" * 50)],
                                  "place_name string")
    pats = ["blue", "BLUE.*X", "^blu[ek].f", "éclair$", "É.LAIR", "a+b", "a{2}b", "x|z", "(b|c)o[xy]", r"a\.b", "", ".", "q?yz", "[ab]{3}", None]
    patterns = spark.createDataFrame([(p,) for p in pats], "place_name string")
    got = {(r.pattern, r.place_name) for r in report.match_names(names, patterns).collect()}
    every = names.crossJoin(patterns.withColumnRenamed("place_name", "pattern"))
    want = every.filter(F.expr("place_name rlike concat('(?iu)', pattern)")).collect()
    assert got == {(r.pattern, r.place_name) for r in want} and len(got) > 20


def test_daily_states_follow_changed_days(spark, tmp_path):
    at = lambda d, h=10: datetime(2024, 1, d, h)
    path = str(tmp_path / "days")
    first = reviews(spark, *[dict(place_name=p, review_datetime_utc=at(d), review_rating=r) for p, d, r in
                             (("A", 18, 5), ("A", 18, None), ("A", 20, 4), ("B", 1, 1), (None, 21, 2))])
    report.save_daily_states(report.daily_states(first), path)
    # the 18th has one review more, the 20th none any more, 20:00 UTC on the 18th is the 19th
    now = reviews(spark, *[dict(place_name=p, review_datetime_utc=t, review_rating=r) for p, t, r in
                           (("A", at(18), 5), ("A", at(18), None), ("A", at(18, 12), 1), ("A", at(18, 20), 3), ("B", at(1), 1), (None, at(21), 2))])
    report.refresh_daily_states(now, [date(2024, 1, 18), date(2024, 1, 19), date(2024, 1, 20)], path)
    states = spark.read.parquet(path)
    for keys in (("place_name", "review_date"), ("place_name",), ()):
        want = report.merged_states(report.daily_states(now), *keys)
        got = report.merged_states(states, *keys).filter("total_reviews > 0")
        assert rows(got, *want.columns) == rows(want, *want.columns)
    shown = report.dashboard(states, AS_OF)
    total = shown.filter("place_name is null and review_date = date'2024-01-18'").first()
    assert (total.total_reviews, total.day_reviews, total.day_average) == (6, 3, 3.0)
    assert rows(shown.filter("place_name = 'B'"), "total_reviews", "review_date", "day_reviews") == [(1, None, 0)]
    assert shown.filter("place_name = 'A' and day_reviews = 0").count() == 5
    assert report.dashboard(report.daily_states(now.limit(0)), AS_OF).count() == 0


def test_titles_and_alert_chain(spark):
    titles = spark.createDataFrame([("g", "Zed"), ("g", "Ann's"), (None, "none")], "google_id string, title string")
    df = reviews(spark, dict(review_id="1"), dict(review_id="2", google_id="other"), dict(review_id="3", google_id=None))
    assert rows(ingest.with_place_title(df, titles), "review_id", "title") == [("1", "Ann's")]
    assert ingest.with_place_title(df, titles.limit(0)).count() == 0
    phones = spark.createDataFrame([("A", ["p"])], "place_name string, phones array<string>")
    raw = reviews(spark, *[dict(review_id=i, review_rating=r) for i, r in (("old", 1), ("new", 1), ("new", 1), ("good", 5))])
    raw = raw.withColumn("arrival", F.monotonically_increasing_id()).withColumn(
        "review_datetime_utc", F.date_format(F.lit(AS_OF), "M/d/yyyy H:m:s"))
    fresh, messages = ingest.alert_chain(raw, reviews(spark, dict(review_id="old")), phones, AS_OF)
    assert rows(fresh, "review_id") == [("good",), ("new",)] and rows(messages, "review_id", "phone") == [("new", "p")]


def test_texts_of_one_split_are_dealt_over_tasks(spark, monkeypatch):
    at = dict(review_datetime_utc=datetime(2024, 1, 20))
    df = reviews(spark, *[dict(review_id=str(i), review_text=f"soup {i % 7} great {i}! " * 20, review_rating=1 + i % 5, **at) for i in range(400)]).coalesce(1)
    week = report.current_week(df, AS_OF)
    whole = [rows(q(week), *q(week).columns) for q in (themes.key_phrases, themes.review_digest)]
    monkeypatch.setattr(themes, "TASK_BYTES", 8_000)
    sizes = [sum(len(r.review_text) for r in part) for part in themes.dealt(week).rdd.glom().collect()]
    assert sum(sizes) > 100_000 and len(sizes) >= sum(sizes) / 8_000 and max(sizes) < 24_000
    assert [rows(q(week), *q(week).columns) for q in (themes.key_phrases, themes.review_digest)] == whole
