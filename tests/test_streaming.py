"""Streams fed in several files: repeats, late rows, restarts, and the batch twin."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.test_rules import DEFAULTS
from venuelens.operators.chat import chat_history, chat_routing
from venuelens.plans.registry import QUERIES
from venuelens.sources import tables as tb
from venuelens.streaming import jobs

SCHEMA = tb.REVIEW_SCHEMA + ", arrival long"
T0 = datetime(2024, 1, 10, 12)


def feed(spark, path, arrivals):
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    made = [{**DEFAULTS, **a} for a in arrivals]
    spark.createDataFrame([tuple(m[c] for c in cols) for m in made], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def source(spark, path, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def row(i, hours, arrival, **more):
    return dict(review_id=i, review_datetime_utc=T0 + timedelta(hours=hours), arrival=arrival, **more)


def test_ingest_repeats_late_and_restart(spark, tmp_path):
    src, sink, mark, alerts = (str(tmp_path / n) for n in ("src", "sink", "mark", "alerts"))
    phones = spark.createDataFrame([("A", ["p1", "p2"])], "place_name string, phones array<string>")
    run = lambda: jobs.stream_alerts(source(spark, src), sink, alerts, phones, mark).awaitTermination()
    feed(spark, src, [row("a", 0, 1, review_rating=1), row("a", 0, 2), row(None, 0, 3), row(None, 0, 4)])
    run()
    feed(spark, src, [row("a", 0, 5), row("b", 20, 6)])
    run()
    feed(spark, src, [row("late", 1, 7), row("c", 15, 8), row("b", 20, 9)])
    run()
    got = sorted((r.review_id or "", r.arrival) for r in spark.read.parquet(sink).collect())
    assert got == [("", 3), ("", 4), ("a", 1), ("b", 6), ("c", 8)]
    sent = sorted((r.review_id, r.phone) for r in spark.read.parquet(alerts).collect())
    assert sent == [("a", "p1"), ("a", "p2")]


def test_late_rows_are_counted(spark, tmp_path):
    src, sink, mark = (str(tmp_path / n) for n in ("src", "sink", "mark"))
    # rows are late by the watermark with which the batch before ended
    for arrivals in ([row("a", 0, 1)], [row("b", 30, 2)], [row("d", 30, 6)],
                     [row("late", 1, 3), row("later", 2, 4), row("c", 29, 5)]):
        feed(spark, src, arrivals)
    query = jobs.stream_ingest(source(spark, src), sink, mark)
    query.awaitTermination()
    assert jobs.late_counts(query) == [(0, 1, 0), (1, 1, 0), (2, 1, 0), (3, 3, 2)]
    assert {r.review_id for r in spark.read.parquet(sink).collect()} == {"a", "b", "c", "d"}


def test_ids_are_read_by_bucket_and_compacted(spark, tmp_path, monkeypatch):
    index = jobs.IdIndex(str(tmp_path / "ids"), buckets=4, limit=2)
    listed = []
    real = jobs._children
    monkeypatch.setattr(jobs, "_children", lambda s, path: listed.append(path) or real(s, path))
    known = set()
    for batch_id in range(9):
        batch = spark.createDataFrame([(f"id{batch_id}",), (f"id{batch_id - 4}",), (None,)], "review_id string")
        for attempt in range(2):  # each batch is run again, as after a failure
            listed.clear()
            buckets = index.touched(batch)
            held = {b: index.folders(spark, b, batch_id) for b in buckets}
            seen = {r[0] for r in index.read(spark, [n for names in held.values() for n in names]).collect()}
            assert {i for i in known if i in (f"id{batch_id}", f"id{batch_id - 4}")} <= seen <= known
            fresh = batch.filter(~F.coalesce(F.col("review_id").isin(list(seen)), F.lit(False)))
            index.add(fresh, batch_id, held)
            assert {int(path.rsplit("=", 1)[1]) for path in listed} <= set(buckets)
        known |= {r[0] for r in batch.collect() if r[0]}
    whole = index.read(spark, [n for b in range(4) for n in index.folders(spark, b, 99)])
    assert sorted(r[0] for r in whole.collect()) == sorted(known)
    assert all(len(index.folders(spark, b, 99)) <= 4 for b in range(4))


def test_ids_of_an_older_table_are_taken_over(spark, tmp_path):
    sink = str(tmp_path / "sink")
    for batch_id, ids in ((-1, []), (0, ["a", None]), (12, ["b"]), (13, ["c"])):
        jobs._write_batch(spark.createDataFrame([(i,) for i in ids], "review_id string"), sink, batch_id)
    index = jobs.IdIndex(f"{sink}/_ids", buckets=3)
    for _ in range(2):
        index.begin(spark.read.schema("review_id string, batch_id long").parquet(sink))
        before = lambda n: sorted(r[0] for r in index.read(spark, [f for b in range(3) for f in index.folders(spark, b, n)]).collect())
        assert (before(0), before(13), before(99)) == ([], ["a", "b"], ["a", "b", "c"])
    assert spark.read.parquet(sink).count() == 4


def test_windows_match_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    for step in range(4):
        feed(spark, src, [row(f"{step}-{h}", step * 24 + h, h, review_rating=1 + h % 5) for h in range(0, 24, 3)])
    feed(spark, src, [row("flush", 400, 1)])
    rows = spark.read.parquet(src)
    for job, days, name in ((jobs.stream_daily_summary, 1, "d"), (jobs.stream_weekly, 7, "w")):
        sink, mark = str(tmp_path / name), str(tmp_path / f"{name}-mark")
        job(source(spark, src), sink, mark).awaitTermination()
        batch = (rows.groupBy(F.window(F.col("review_datetime_utc").cast("timestamp"), f"{days} days", "1 day", jobs.LOCAL_MIDNIGHT))
                 .count().select(F.col("window.end").cast("timestamp_ntz").alias("e"), "count"))
        closed = T0 + timedelta(hours=400 - 8)
        want = {(r.e, r["count"]) for r in batch.collect() if r.e <= closed}
        got = {(r.window_end, r.total_reviews) for r in spark.read.parquet(sink).collect()}
        assert got == want and len(got) >= 4


def test_chat_in_pieces_equals_batch(spark, tmp_path):
    src, sink, mark = (str(tmp_path / n) for n in ("src", "sink", "mark"))
    schema = "user string, turn long, role string, text string"
    texts = ["hi", "👎", "thanks", "it was late", "👎", "👎", "sorry", "👍", "top items", "👎", "hello!", "wrong sum", "again"]
    msgs = [(u, 2 * i + j, role, f"re {t}" if j else t) for u in ("x", "y") for i, t in enumerate(texts)
            for j, role in ((0, "user"), (1, "assistant"))]
    for lo in range(0, 26, 3):
        part = [m for m in msgs if lo <= m[1] < lo + 3 and not (m[0] == "y" and lo % 2)]
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
            jobs.stream_chat(source(spark, src, schema), sink, mark).awaitTermination()
    seen = spark.read.parquet(src)
    want = {(r.user, r.turn): r.history for r in chat_history(seen).collect()}
    intents = {(r.user, r.turn): r.intent for r in chat_routing(seen).collect()}
    got = spark.read.parquet(f"{sink}/out").collect()
    assert {(r.user, r.turn): r.history for r in got if r.history is not None} == want
    assert {(r.user, r.turn): r.intent for r in got if r.intent} == intents


def test_stream_reads_a_table_of_one_file_or_many(spark, tmp_path):
    rows = spark.createDataFrame([(c, t, "user", "q") for c in range(40) for t in (0, 2)], "conv_id long, turn long, role string, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "conversations.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "made").glob("part-*.parquet")).rename(tmp_path / "one" / "conversations.parquet")
    rows.limit(0).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    counts = {n: QUERIES["stream_chat"](spark, str(tmp_path / n)).count() for n in ("many", "one", "none")}
    assert counts == {"many": 80, "one": 80, "none": 0}
