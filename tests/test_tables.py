"""Sinks, logs, state and loaders on real files."""

from datetime import date, datetime

from venuelens.sources import tables as tb


def test_state_versions(spark, tmp_path):
    root = str(tmp_path / "state")
    first = spark.createDataFrame([("A", "w", date(2024, 1, 1)), ("B", "w", date(2024, 1, 1))], tb.STATE_SCHEMA)
    tb.save_state(first, root, 1)
    new = spark.createDataFrame([("B", "w", date(2024, 1, 8)), ("C", "w", date(2024, 1, 8)), (None, "w", date(2024, 1, 8))], tb.STATE_SCHEMA)
    tb.save_state(tb.upsert_state(tb.read_state(spark, root), new, ["place_name", "report_type"]), root, 2)
    got = {r.place_name: r.last_report_date.day for r in tb.read_state(spark, root).collect()}
    assert got == {"A": 1, "B": 8, "C": 8, None: 8}


def test_report_sink_replaces_only_its_folders(spark, tmp_path):
    path = str(tmp_path / "report")
    df = lambda *r: spark.createDataFrame(list(r), "place_name string, n int")
    tb.write_report(df(("A", 1), ("B", 1)), path, date(2024, 1, 8))
    tb.write_report(df(("A", 2)), path, date(2024, 1, 8))
    tb.write_report(df(("A", 3)), path, date(2024, 1, 15))
    got = sorted((r.place_name, str(r.report_date), r.n) for r in spark.read.parquet(path).collect())
    assert got == [("A", "2024-01-08", 2), ("A", "2024-01-15", 3), ("B", "2024-01-08", 1)]


def test_sent_log(spark, tmp_path):
    path = str(tmp_path / "log")
    one = spark.createDataFrame([("A", tb.DAILY_SUMMARY, date(2024, 1, 8))], tb.SENT_SCHEMA)
    tb.append_sent(one, path)
    tb.append_sent(one, path)
    assert spark.read.parquet(path).count() == 2


def test_loaders(spark, tmp_path):
    root = str(tmp_path)
    for name, schema in tb.POS_SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{root}/{name}")
    odd = spark.createDataFrame([("Soup", 2.0, 1.0, 2.0, "Food", "R", "M", date(2024, 1, 1))],
                                "ItemName string, Rate double, Qty double, TotalAmount double, Classification string, "
                                "RestaurantName string, MenuName string, Date date")
    odd.write.mode("overwrite").parquet(f"{root}/itemwise")
    loaded = tb.load_pos(spark, root)
    assert loaded["itemwise"].first().item_name == "Soup"
    assert dict(loaded["itemwise"].dtypes)["total_amount"] == "decimal(18,2)"
    assert set(loaded) == set(tb.POS_SCHEMAS)
    renamed = tb.snake_case(spark.createDataFrame([(1, 2)], "`Vist Count` int, `Table(s)` int"))
    assert renamed.columns == ["visit_count", "tables"]


def test_read_reviews(spark, tmp_path):
    path = str(tmp_path / "reviews")
    spark.createDataFrame([], tb.REVIEW_SCHEMA).write.json(path)
    assert tb.read_reviews(spark, path, fmt="json").columns == tb.REPORT_COLUMNS


def test_artifacts(spark):
    got = tb.report_artifacts(spark.createDataFrame([("The Inn",)], "place_name string"), datetime(2024, 1, 8), "https://x/").first()
    assert got.artifact_name == "The Inn_weekly_report_20240108.pdf"
    assert got.artifact_url == "https://x/The%20Inn_weekly_report_20240108.pdf"
