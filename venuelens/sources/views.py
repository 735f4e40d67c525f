"""The job inputs derived from the generic test tables (rules in FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from venuelens.session import spread

PLACE_IDS = ["click", "error", "purchase", "signup", "view"]
MONEY = "decimal(18,2)"
QTY = "decimal(18,3)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def shape_reviews(events: DataFrame) -> DataFrame:
    """Review columns from event columns; ``text`` is null unless joined in. Works on a stream too."""
    k = F.col("k")
    digit = F.floor(k / 5) % 5
    questions = (F.when(digit == 0, F.lit("{}"))
                 .when(digit == 1, F.lit("{'Food': 4, 'Service': 3, 'Atmosphere': 5}"))
                 .when(digit == 2, F.lit("{'Food': null, 'Service': 2}"))
                 .when(digit == 3, F.lit("{'Food': 'x', 'Service': 1}"))
                 .otherwise(F.lit('{"Food": 2, "Atmosphere": 1}')))
    src = events.withColumn("k", _k())
    if "text" not in src.columns:
        src = src.withColumn("text", F.lit(None).cast("string"))
    return src.select(
        F.col("event_type").alias("place_name"),
        F.concat(F.lit("G-"), "event_type").alias("google_id"),
        F.col("event_id").cast("string").alias("review_id"),
        F.when(k % 20 != 7, F.concat(F.lit("Guest "), F.col("user_id").cast("string"))).alias("author_title"),
        F.col("user_id").cast("string").alias("author_id"),
        F.col("text").alias("review_text"),
        questions.alias("review_questions"),
        F.concat(F.lit("https://reviews.example/"), F.col("event_id").cast("string")).alias("review_link"),
        (F.lit(1) + k % 5).cast("int").alias("review_rating"),
        F.col("ts").alias("review_datetime_utc"),
        (F.col("user_id") % 50).cast("int").alias("author_reviews_count"),
        (F.col("user_id") % 30).cast("int").alias("author_ratings_count"),
        F.when(k % 10 != 0, (k - 50) / F.lit(50.0)).alias("sentiment_score"))


def reviews(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """``text=False`` leaves out the document join for jobs that do not read the text."""
    events = table(spark, sf_dir, "events")
    if text:
        docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
        events = spread(events, "event_id").join(docs.withColumnRenamed("doc_id", "event_id"), "event_id", "left")
    return shape_reviews(events)


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files: a pattern path lists either."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed as it arrives: time as text, some rows sent twice, some without an id."""
    return (feed(reviews(spark, sf_dir))
            .withColumn("review_datetime_utc",
                        F.date_format("review_datetime_utc", "M/d/yyyy HH:mm:ss")))


def feed(shaped: DataFrame) -> DataFrame:
    """Arrival order added; some rows come a second time with another text, some have no id."""
    times = F.when(F.col("author_reviews_count") % 7 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    number = F.col("review_id").cast("bigint")
    return (shaped.withColumn("copy", F.explode(times))
            .withColumn("arrival", number + F.col("copy") * F.lit(1_000_000_000_000))
            .withColumn("review_id", F.when(number % 97 != 0, F.col("review_id")))
            .withColumn("review_text", F.when(F.col("copy") == 1, F.lit("sent again")).otherwise(F.col("review_text")))
            .drop("copy"))


def place_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("place_name")).distinct()


def place_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by place id; the place of the longest name is not listed."""
    name = F.col("place_name")
    return place_dim(spark, sf_dir).filter(F.length(name) < 8).select(
        F.concat(F.lit("G-"), name).alias("google_id"), F.concat(F.lit("The "), F.initcap(name)).alias("title"))


def recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's nations stand for the phones of one place; the last place has none."""
    nation = table(spark, sf_dir, "nation")
    name = F.when(F.col("n_regionkey") == 0, PLACE_IDS[0])
    for i in range(1, 4):
        name = name.when(F.col("n_regionkey") == i, PLACE_IDS[i])
    return (nation.select(name.alias("place_name"), F.concat(
        F.lit("+91000000"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0")).alias("phone"))
        .filter(F.col("place_name").isNotNull())
        .groupBy("place_name").agg(F.sort_array(F.collect_list("phone")).alias("phones")))


def itemwise(spark: SparkSession, sf_dir: str, restaurant: bool = True) -> DataFrame:
    """Sold lines; one without a supplier has a null restaurant, and counts with and without that column."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    df = li.join(part, "l_partkey")
    name = F.lit(None).cast("string")
    if restaurant:
        df = df.join(table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey", "left")
        name = F.col("s_name")
    return df.select(
        F.col("p_name").alias("item_name"), F.col("p_retailprice").cast(MONEY).alias("rate"),
        F.col("l_quantity").cast(QTY).alias("qty"),
        F.col("l_extendedprice").cast(MONEY).alias("total_amount"),
        F.col("p_type").alias("classification"), name.alias("restaurant_name"),
        F.col("p_brand").alias("menu_name"), F.col("l_shipdate").cast("date").alias("date"))


CATEGORIES = {"food": "ECONOMY", "liquor": "SMALL", "soft_drinks": "MEDIUM",
              "beer": "PROMO", "wine": "STANDARD", "smokes": "LARGE"}


def sales_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order. The order columns are grouping keys, so that a period filter
    moves below the aggregate and only the period's lines are joined and summed."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    lines = (table(spark, sf_dir, "lineitem").join(part, "l_partkey")
             .select(F.col("l_orderkey").alias("o_orderkey"), "p_type", "l_extendedprice"))
    order_cols = ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"]
    amount = F.col("l_extendedprice").cast(MONEY)
    bills = (table(spark, sf_dir, "orders").select(*order_cols).join(lines, "o_orderkey", "left")
             .groupBy(*order_cols).agg(
                 *[F.sum(F.when(F.col("p_type") == t, amount)).cast(MONEY).alias(c) for c, t in CATEGORIES.items()]))
    zero = F.lit(0).cast(MONEY)
    gross = F.col("o_totalprice").cast(MONEY)
    paid = F.col("o_orderkey") % 3

    def pay(i: int) -> Column:
        return F.when(paid == i, gross).otherwise(zero)

    return bills.select(
        F.col("o_orderdate").cast("date").alias("bill_date"), F.col("o_orderkey").alias("bill_number"),
        (F.col("o_custkey") % 40).cast("int").alias("table_number"),
        (F.lit(1) + F.col("o_orderkey") % 6).cast("int").alias("pax"), gross.alias("gross_amount"),
        pay(0).alias("cash"), pay(1).alias("credit_card"), pay(2).alias("company"),
        *[F.coalesce(F.col(c), zero).alias(c) for c in CATEGORIES],
        F.col("o_orderdate").alias("time"), F.col("o_orderdate").cast("date").alias("extracted_date"))


def kot(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return li.join(part, "l_partkey").join(orders, "l_orderkey").select(
        F.col("l_orderkey").alias("kot"),
        (F.col("l_shipdate") + F.make_dt_interval(hours=(F.col("l_orderkey") % 24).cast("int"))).alias("kot_time"),
        (F.col("o_custkey") % 40).cast("int").alias("table_number"), F.col("p_name").alias("item_name"),
        F.col("p_retailprice").cast(MONEY).alias("rate"), F.col("l_quantity").cast(QTY).alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("total_amount"), F.col("l_orderkey").alias("bill_number"),
        F.lit("Main").alias("restaurant_name"), F.col("p_type").alias("classification"),
        F.col("l_linestatus").alias("type"), F.col("p_brand").alias("class_name"),
        F.col("l_shipdate").cast("date").alias("date"))


def issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    supplier = table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    return li.join(part, "l_partkey").join(supplier, "l_suppkey").select(
        F.col("p_name").alias("item_name"), F.lit("EA").alias("units"), F.col("s_name").alias("issue_name"),
        F.col("l_extendedprice").cast(MONEY).alias("amount"), F.col("p_retailprice").cast(MONEY).alias("rate"),
        F.col("l_quantity").cast(QTY).alias("quantity"), F.col("l_shipdate").cast("date").alias("date"))


def footfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    status = (F.when(k % 4 == 0, "Seated").when(k % 4 == 1, "Cancelled")
              .when(k % 4 == 2, "No show").otherwise("Completed"))
    kind = F.when(k % 3 == 0, "Walk in").when(k % 3 == 1, "Online").otherwise("Phone")
    who = F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").withColumn("k", _k()).select(
        F.col("event_id").alias("sno"), F.col("ts").alias("booking_time"),
        F.when(k % 4 != 1, F.col("ts") + F.make_dt_interval(mins=k)).alias("seated_time"),
        (F.col("ts") + F.make_dt_interval(mins=F.lit(30))).alias("reserved_time"),
        kind.alias("booking_type"), F.concat(F.lit("Guest "), who).alias("guest_name"),
        F.concat(F.lit("guest"), who, F.lit("@guests.example")).alias("guest_email"),
        (F.lit(1) + k % 8).cast("int").alias("pax"),
        F.concat(F.lit("Section "), (F.col("user_id") % 4).cast("string")).alias("sections"),
        F.concat(F.lit("T"), (F.col("user_id") % 40).cast("string")).alias("tables"),
        (F.lit(1) + k % 3).cast("int").alias("visit_count"), status.alias("booking_status"),
        F.when(k % 4 == 1, "Guest").alias("deletion_type"), F.col("event_type").alias("source_of_booking"))


def chat_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).select(
        F.col("review_rating").alias("rating"), F.col("review_text").alias("review"),
        F.col("place_name").alias("dining"), F.col("review_datetime_utc").alias("time"),
        F.col("review_id").cast("bigint").alias("review_no"))


def pos(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"footfall": footfall(spark, sf_dir), "issue": issue(spark, sf_dir),
            "itemwise": itemwise(spark, sf_dir), "kot": kot(spark, sf_dir),
            "chat_reviews": chat_reviews(spark, sf_dir), "sales_book": sales_book(spark, sf_dir)}


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return table(spark, sf_dir, "embeddings").join(docs, "vec_id", "left").select(
        F.col("vec_id").alias("id"), F.col("text").alias("page_content"),
        (F.lit(1) + F.col("label") % 5).cast("int").alias("rating"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 30).cast("int")).alias("day"),
        "embedding")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per stored vector: two ratings, seven days, its vector as the question's."""
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 26).cast("int"))
    first = (F.lit(1) + F.col("label") % 5).cast("string")
    second = (F.lit(1) + (F.col("label") + 1) % 5).cast("string")
    # every eleventh range ends before it starts
    length = F.when(F.col("vec_id") % 11 == 10, F.lit(-2)).otherwise(F.lit(6))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("request_id"),
        F.concat(F.lit("what about "), F.col("vec_id").cast("string")).alias("question"),
        F.concat_ws(",", first, second).alias("rating"),
        F.date_format(start, "yyyy-MM-dd").alias("start_date"),
        F.date_format(F.date_add(start, length), "yyyy-MM-dd").alias("end_date"),
        "embedding")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_messages(table(spark, sf_dir, "conversations"))


def shape_messages(conversations: DataFrame) -> DataFrame:
    """Conversations with some turns replaced by small talk, thumbs and pipe tables."""
    conv, turn = F.col("conv_id"), F.col("turn")
    user = F.col("role") == "user"
    number = conv.cast("string")
    table_text = F.concat(
        F.lit("Here you are:\n##| Item | Qty |\n|------|-----|\n| Tea "), number, F.lit(" | "),
        turn.cast("string"), F.lit(" |\n| Total | |\n##\n"), F.lit("More:\n## | A | B |\n|-|-|\n|"),
        number, F.lit("|x| ## tail"))
    text = (F.when(user & (turn == 0) & (conv % 5 == 0), F.lit(" Hi! "))
            .when(user & (turn == 0) & (conv % 5 == 1), F.lit("How's it going?"))
            .when(user & (turn == 2) & (conv % 3 == 0), F.lit("👎"))
            .when(user & (turn == 4) & (conv % 4 == 0), F.lit("thanks."))
            .when(user & (turn == 4) & (conv % 4 == 1), F.lit("👍"))
            .when(user & (turn == 6) & (conv % 2 == 0), F.lit("What can you do?"))
            .when((F.col("role") == "assistant") & (turn == 1) & (conv % 2 == 0), table_text)
            .when((F.col("role") == "assistant") & (turn == 3) & (conv % 4 == 1),
                  F.concat(F.lit("No rule ##| A | B |\n| 1 | "), number, F.lit(" |##")))
            .otherwise(F.col("text")))
    return conversations.select(
        number.alias("user"), "turn", "role", text.alias("text"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authorised users: customers with a positive balance."""
    return (table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 0)
            .select(F.col("c_custkey").cast("string").alias("user")))


def misspelt_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part and brand names with one letter left out, the place chosen by the part key."""
    cut = (F.col("p_partkey") % 5 + 2).cast("int")
    name = F.when(F.col("p_partkey") % 9 == 0, F.col("p_brand")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.substring(name, F.lit(1), cut - 1), F.substring(name, cut + 1, F.lit(1000))).alias("term")).distinct()


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place names, one-letter pieces of them and regular expressions built from them."""
    dim = place_dim(spark, sf_dir)
    name = F.col("place_name")
    forms = F.array(F.upper(name), F.substring(name, 2, 1),
                    F.concat(F.lit("^"), F.substring(name, 1, 1), F.lit(".*[ekw]$")))
    return dim.select(F.explode(forms).alias("place_name")).distinct()


def sent_log(spark: SparkSession, sf_dir: str, kind: str, sent_on) -> DataFrame:
    """Places with an even name length have had their summary on ``sent_on``."""
    return (place_dim(spark, sf_dir).filter(F.length("place_name") % 2 == 0)
            .select("place_name", F.lit(kind).alias("notification_type"), F.lit(sent_on).alias("sent_date")))


def report_state(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    shift = (F.length("place_name") - 4) * 3
    return (place_dim(spark, sf_dir).filter(F.length("place_name") > 4)
            .select("place_name", F.lit(kind).alias("report_type"),
                    F.date_add(F.lit("2024-01-13").cast("date"), shift).alias("last_report_date")))
