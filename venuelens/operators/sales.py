"""Point-of-sale questions as parameterised jobs. ``p0`` is inclusive, ``p1`` exclusive.
Money is summed as decimal; means are rounded from the exact sums."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuelens.functions import clock
from venuelens.functions.text import indian_rupees
from venuelens.operators.skew import top_k
from venuelens.sources.views import CATEGORIES

MONEY = "decimal(18,2)"


def _money(total: Column, name: str) -> Column:
    return total.cast(MONEY).alias(name)


def _mean(total: Column, count: Column) -> Column:
    """Exact decimal mean, to two digits."""
    return (total / count).cast(MONEY)


def _in_period(col: Column, p0: date, p1: date) -> Column:
    return (col >= clock.day(p0)) & (col < clock.day(p1))


def _booked(f: DataFrame, p0: date, p1: date) -> DataFrame:
    """Bookings of a period; compared as timestamps, so the filter reaches the scan."""
    ts = F.col("booking_time")
    low, high = (F.expr(f"timestamp_ntz'{p} 00:00:00'") for p in (p0, p1))
    return f.filter((ts >= low) & (ts < high))


def sales_period(items: DataFrame, p0: date, p1: date) -> DataFrame:
    return items.filter(_in_period(F.col("date"), p0, p1))


def _item_sales(items: DataFrame) -> DataFrame:
    return items.groupBy("item_name").agg(
        _money(F.sum("total_amount"), "total_sales"), F.sum("qty").cast("decimal(18,3)").alias("total_qty"))


def top_items(items: DataFrame, p0: date, p1: date, n: int = 3) -> DataFrame:
    return (_item_sales(sales_period(items, p0, p1))
            .orderBy(F.col("total_sales").desc(), "item_name").limit(n))


def top_items_display(top: DataFrame) -> DataFrame:
    return top.select("item_name", indian_rupees(F.col("total_sales")).alias("total_sales_amount"))


def best_item_by_month(items: DataFrame) -> DataFrame:
    month = F.trunc("date", "month").alias("month")
    sales = items.groupBy(month, "item_name").agg(_money(F.sum("total_amount"), "total_sales"))
    return top_k(sales, ["month"], [F.col("total_sales").desc(), F.col("item_name")], 1).drop("rank")


def sales_weekly_rollup(book: DataFrame, p0: date, p1: date) -> DataFrame:
    """Sunday weeks cut to the period, with the six categories and a ``Total`` row."""
    d = F.col("bill_date")
    sunday = lambda x: F.date_sub(x, F.dayofweek(x) - 1)
    last = F.date_sub(clock.day(p1), 1)
    rows = book.filter(_in_period(d, p0, p1)).select(
        (F.floor(F.datediff(sunday(d), sunday(clock.day(p0))) / 7) + 1).cast("int").alias("no"),
        F.greatest(sunday(d), clock.day(p0)).alias("week_start"),
        F.least(F.date_add(sunday(d), 6), last).alias("week_end"), "gross_amount", *CATEGORIES)
    weeks = rows.groupBy("no", "week_start", "week_end").agg(
        F.sum("gross_amount").alias("gross_amount"), *[F.sum(c).alias(c) for c in CATEGORIES])
    # the weeks are few: the Total row is rolled up from them, not from the bills
    line = F.struct("no", "week_start", "week_end").alias("line")
    return (weeks.select(line, "gross_amount", *CATEGORIES).rollup("line").agg(
        F.grouping("line").alias("g"), _money(F.sum("gross_amount"), "total_sales"),
        *[_money(F.sum(c), f"{c}_sales") for c in CATEGORIES])
        .select(F.when(F.col("g") == 1, "Total").otherwise(F.col("line.no").cast("string")).alias("week"),
                F.col("line.week_start").alias("week_start"), F.col("line.week_end").alias("week_end"),
                "total_sales", *[f"{c}_sales" for c in CATEGORIES]))


def category_sales(items: DataFrame, p0: date, p1: date) -> DataFrame:
    return sales_period(items, p0, p1).groupBy("classification").agg(
        _money(F.sum("total_amount"), "total_sales"), F.sum("qty").cast("decimal(18,3)").alias("total_qty"))


def category_sales_book(book: DataFrame, p0: date, p1: date) -> DataFrame:
    """The same from the bill table's six category columns, turned into rows after the sum."""
    sums = book.filter(_in_period(F.col("bill_date"), p0, p1)).agg(*[_money(F.sum(c), c) for c in CATEGORIES])
    return sums.unpivot([], list(CATEGORIES), "category", "total_sales")


def footfall_daily(f: DataFrame, p0: date, p1: date) -> DataFrame:
    return _booked(f, p0, p1).groupBy(F.col("booking_time").cast("date").alias("booking_date")).agg(
        F.count(F.lit(1)).alias("bookings"), F.sum("pax").alias("guests"),
        F.count(F.when(F.col("visit_count") > 1, 1)).alias("repeat_visits"))


def footfall_by_source(f: DataFrame, p0: date, p1: date) -> DataFrame:
    """Bookings and guests by source, status, type and section, each over the whole period."""
    dims = ["source_of_booking", "booking_status", "booking_type", "sections"]
    base = _booked(f, p0, p1).groupBy(*dims).agg(
        F.count(F.lit(1)).alias("bookings"), F.sum("pax").alias("guests"))
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims]))
    return (base.select(pairs.alias("p"), "bookings", "guests")
            .groupBy("p.dimension", "p.value").agg(F.sum("bookings").alias("bookings"), F.sum("guests").alias("guests")))


def seating_delay(f: DataFrame) -> DataFrame:
    minutes = F.timestamp_diff("MINUTE", F.col("booking_time"), F.col("seated_time"))
    rows = f.filter(F.col("seated_time").isNotNull()).select("sections", minutes.alias("wait"))
    return rows.groupBy("sections").agg(
        F.count(F.lit(1)).alias("seated"), F.round(F.avg("wait"), 4).alias("average_wait"), F.max("wait").alias("longest_wait"))


def seating_delay_days(f: DataFrame) -> DataFrame:
    """Mergeable state of the waits: parties seated per section, day and whole minutes waited. A day's rows never change
    once it is over, and days merge by adding; a section has at most as many rows a day as there are different waits."""
    wait = F.timestamp_diff("MINUTE", F.col("booking_time"), F.col("seated_time"))
    return (f.filter(F.col("seated_time").isNotNull()).groupBy("sections", F.to_date("booking_time").alias("day"), wait.alias("wait"))
            .agg(F.count(F.lit(1)).alias("seated")))


def seating_delay_percentiles(days: DataFrame, p0: date, p1: date, points: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """Exact percentiles of the wait per section over a period, from the daily states: the shortest wait that at least so
    many percent of the parties did not exceed. Null sections are a section."""
    merged = (days.filter(_in_period(F.col("day"), p0, p1)).groupBy("sections", "wait").agg(F.sum("seated").alias("n")))
    section = Window.partitionBy("sections")
    ranked = (merged.withColumn("so_far", F.sum("n").over(section.orderBy("wait").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
              .withColumn("all", F.sum("n").over(section)))
    return ranked.groupBy("sections").agg(F.sum("n").alias("seated"), *[
        F.min(F.when(F.col("so_far") * 100 >= F.col("all") * p, F.col("wait"))).alias(f"p{p}") for p in points])


def issue_by_department(issue: DataFrame, p0: date, p1: date) -> DataFrame:
    """Quantity, cost and mean rate per department and item; a null item is the department's total."""
    base = issue.filter(_in_period(F.col("date"), p0, p1)).groupBy("issue_name", "item_name").agg(
        F.sum("quantity").alias("q"), F.sum("amount").alias("a"), F.sum("rate").alias("r"), F.count("rate").alias("n"))
    return base.groupingSets([[F.col("issue_name")], [F.col("issue_name"), F.col("item_name")]],
                             F.col("issue_name"), F.col("item_name")).agg(
        F.sum("q").cast("decimal(18,3)").alias("quantity"), _money(F.sum("a"), "cost"),
        _mean(F.sum("r"), F.sum("n")).alias("average_rate"))


def kot_items(kot: DataFrame, p0: date, p1: date) -> DataFrame:
    return sales_period(kot, p0, p1).groupBy("item_name").agg(
        F.count(F.lit(1)).alias("tickets"), F.sum("quantity").cast("decimal(18,3)").alias("quantity"),
        _money(F.sum("total_amount"), "amount"))


def kot_hourly(kot: DataFrame) -> DataFrame:
    return kot.groupBy(F.hour("kot_time").alias("hour")).agg(
        F.count(F.lit(1)).alias("tickets"), F.sum("quantity").cast("decimal(18,3)").alias("quantity"),
        _money(F.sum("total_amount"), "amount"))


def kot_tables(kot: DataFrame) -> DataFrame:
    return kot.groupBy("table_number").agg(
        F.count(F.lit(1)).alias("tickets"), F.sum("quantity").cast("decimal(18,3)").alias("quantity"),
        _money(F.sum("total_amount"), "amount"))


def kot_bill_items(kot: DataFrame, bills: DataFrame) -> DataFrame:
    """Items on the given bills (``bill_number``)."""
    return (kot.join(bills.select("bill_number").distinct(), "bill_number", "left_semi")
            .groupBy("bill_number", "item_name").agg(
                F.sum("quantity").cast("decimal(18,3)").alias("quantity"), _money(F.sum("total_amount"), "amount")))


def financial_summary(book: DataFrame, p0: date, p1: date) -> DataFrame:
    return book.filter(_in_period(F.col("bill_date"), p0, p1)).agg(
        F.count(F.lit(1)).alias("bills"), _money(F.sum("gross_amount"), "gross_sales"),
        F.sum("pax").alias("guests"), _mean(F.sum("gross_amount"), F.count("gross_amount")).alias("average_bill"),
        _mean(F.sum("gross_amount"), F.sum("pax")).alias("spend_per_guest"))


def item_averages(items: DataFrame, p0: date, p1: date) -> DataFrame:
    """Total sales, quantity and mean rate over a period."""
    return sales_period(items, p0, p1).agg(
        _money(F.sum("total_amount"), "total_sales"), F.sum("qty").cast("decimal(18,3)").alias("quantity"),
        _mean(F.sum("rate"), F.count("rate")).alias("average_rate"))


def payment_mix(book: DataFrame, p0: date, p1: date) -> DataFrame:
    kinds = ["cash", "credit_card", "company"]
    sums = book.filter(_in_period(F.col("bill_date"), p0, p1)).agg(*[_money(F.sum(c), c) for c in kinds])
    total = sums.withColumn("all_paid", sum((F.col(c) for c in kinds[1:]), F.col(kinds[0])))
    return total.unpivot(["all_paid"], kinds, "payment", "amount").select(
        "payment", "amount",
        F.try_divide(F.col("amount") * 100, F.col("all_paid")).cast("decimal(5,2)").alias("percent"))


def low_star_reviews(r: DataFrame, p0: date, p1: date, max_rating: int = 2) -> DataFrame:
    """Reviews with few stars in a period, all of them."""
    ts = F.col("time")
    low, high = (F.expr(f"timestamp_ntz'{p} 00:00:00'") for p in (p0, p1))
    return r.filter((F.col("rating") <= max_rating) & (ts >= low) & (ts < high))


def review_counts(r: DataFrame, p0: date, p1: date) -> DataFrame:
    ts = F.col("time")
    low, high = (F.expr(f"timestamp_ntz'{p} 00:00:00'") for p in (p0, p1))
    return r.filter((ts >= low) & (ts < high)).groupBy("rating").agg(F.count(F.lit(1)).alias("review_count"))
