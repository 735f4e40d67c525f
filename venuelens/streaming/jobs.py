"""Review and chat streams.

Sinks that need exactly-once rows write one ``batch_id=N`` folder per micro-batch and
overwrite it on a retry, so a repeated batch leaves no second copy. Watermarks need
``timestamp``, so event times are cast with the session zone UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from venuelens.operators.chat import conversation, intent
from venuelens.operators.ingest import alert_messages, alerts_select, insert_new
from venuelens.operators.skew import top_k
from venuelens.operators.summary import star_counts

LOCAL_MIDNIGHT = "18 hours 30 minutes"  # 00:00 at +05:30, in UTC
ARRIVED = "arrived"  # observed: rows of a micro-batch before any is dropped


def _event_time(src: DataFrame, hours: int) -> DataFrame:
    src.sparkSession.conf.set("spark.sql.session.timeZone", "UTC")
    return (src.withColumn("event_time", F.col("review_datetime_utc").cast("timestamp"))
            .withWatermark("event_time", f"{hours} hours"))


def accept(src: DataFrame, hours: int = 8) -> DataFrame:
    """Drops rows later than the watermark, and repeats of an id within it. A row without an id is no repeat of
    any other: its key is its arrival."""
    key = F.coalesce(F.col("review_id"), F.concat(F.lit("arrival "), F.col("arrival").cast("string")))
    return (_event_time(src, hours).withColumn("_key", key)
            .dropDuplicatesWithinWatermark(["_key"]).drop("_key", "event_time"))


def _seed(spark: SparkSession, schema: StructType, path: str) -> None:
    """An empty first folder, so that the table can be read before the first batch."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/batch_id=-1")


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _drop_path(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, where = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


class IdIndex:
    """Ids of stored reviews, in folders by hash bucket: a micro-batch lists and reads the buckets of its own ids only.

    A bucket holds a folder per batch that added to it (``piece=<batch>-new``). Once more than ``limit`` have gathered, the next
    batch writes all of the bucket's ids again as one folder (``-all``), with which reading starts from then on; folders
    before the one it started from itself are removed, as no retry reads them. What a batch reads depends on earlier
    batches alone, so a retry finds the same. Rows without an id are not kept. ``buckets`` and ``splits`` are to be chosen
    so that a bucket's ids, a ``splits``-th of them, suit a task; ``buckets`` must not change while a table is in use.
    """

    def __init__(self, path: str, buckets: int = 256, splits: int = 1, limit: int = 16) -> None:
        self.path, self.buckets, self.splits, self.limit = path, buckets, splits, limit

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("review_id"), F.lit(self.buckets)).cast("int")

    def begin(self, table: DataFrame) -> None:
        """Fills the folders from ``table`` (review_id, batch_id) unless that has been done: a table may be older than
        its folders. Ids keep their batch, so a batch that is run again does not meet its own."""
        if "_SUCCESS" in _children(table.sparkSession, self.path):
            return
        (table.filter(F.col("review_id").isNotNull() & (F.col("batch_id") >= 0)).select(
            "review_id", self.bucket().alias("bucket"), F.format_string("%010d-new", "batch_id").alias("piece"))
         .repartition("bucket", F.pmod(F.hash("review_id"), F.lit(self.splits)))
         .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket", "piece").parquet(self.path))

    def folders(self, spark: SparkSession, bucket: int, batch_id: int) -> list[str]:
        """Folders of one bucket that hold what batches before ``batch_id`` stored, the whole one first."""
        names = sorted(n for n in _children(spark, f"{self.path}/bucket={bucket}") if n.startswith("piece="))
        names = [n for n in names if int(n[6:16]) < batch_id]
        whole = [i for i, n in enumerate(names) if n.endswith("-all")]
        return [f"{self.path}/bucket={bucket}/{n}" for n in names[whole[-1] if whole else 0:]]

    def touched(self, batch: DataFrame) -> list[int]:
        rows = batch.filter(F.col("review_id").isNotNull()).select(self.bucket().alias("bucket")).distinct().collect()
        return sorted(r["bucket"] for r in rows)  # at most ``buckets`` numbers

    def read(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], "review_id string")
        return spark.read.schema("review_id string").parquet(*folders)

    def add(self, fresh: DataFrame, batch_id: int, held: dict[int, list[str]]) -> None:
        """Stores the ids of ``fresh``; ``held`` has the folders by bucket that the batch started from."""
        spark = fresh.sparkSession
        full = [b for b, names in held.items() if len(names) > self.limit]
        ids = fresh.filter(F.col("review_id").isNotNull()).select("review_id", self.bucket().alias("bucket"))
        if full:
            ids = ids.unionByName(self.read(spark, [n for b in full for n in held[b]]).select("review_id", self.bucket().alias("bucket")))
        kind = F.when(F.col("bucket").isin(full), "-all").otherwise("-new")
        (ids.withColumn("piece", F.concat(F.lit(f"{batch_id:010d}"), kind))
         .repartition("bucket", F.pmod(F.hash("review_id"), F.lit(self.splits)))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "piece").parquet(self.path))
        for b, names in held.items():
            for name in _children(spark, f"{self.path}/bucket={b}") if names and names[0].endswith("-all") else ():
                if name.startswith("piece=") and name < names[0].rsplit("/", 1)[1]:
                    _drop_path(spark, f"{self.path}/bucket={b}/{name}")


def stream_ingest(src: DataFrame, sink: str, checkpoint: str, hours: int = 8,
                  alerts_sink: str | None = None, recipients: DataFrame | None = None, buckets: int = 256) -> StreamingQuery:
    """New reviews into ``sink``: the watermark drops late rows, the state forgets old ids, so the batch is also held
    against the ids stored before, in the buckets that it touches (``IdIndex`` in ``sink``/_ids, which readers of ``sink``
    pass over). With ``alerts_sink`` the new rows' alert messages are written from the same batch; their key is
    (review_id, phone). ``late_counts`` tells how many rows came too late."""
    spark = src.sparkSession
    arrived = src.observe(ARRIVED, F.count(F.lit(1)).alias("rows"))
    accepted = accept(arrived, hours)
    schema = accepted.schema
    _seed(spark, schema, sink)
    index = IdIndex(f"{sink}/_ids", buckets)
    index.begin(spark.read.schema("review_id string, batch_id long").parquet(sink))

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch = batch.persist()  # read by both sides of the insert: the state runs once
        held = {b: index.folders(session, b, batch_id) for b in index.touched(batch)}
        known = index.read(session, [n for names in held.values() for n in names])
        _write_batch(insert_new(batch, known), sink, batch_id)
        batch.unpersist()
        stored = session.read.schema(schema).parquet(f"{sink}/batch_id={batch_id}")
        index.add(stored, batch_id, held)
        if alerts_sink is not None:
            _write_batch(alert_messages(alerts_select(stored), recipients), alerts_sink, batch_id)

    return (accepted.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def late_counts(query: StreamingQuery) -> list[tuple[int, int, int]]:
    """(batch, rows that arrived, rows dropped as later than the watermark) of the micro-batches whose progress the
    query still holds (``spark.sql.streaming.numRecentProgressUpdates`` of them, those without data left out)."""
    out = []
    for p in query.recentProgress:
        arrived = p.observedMetrics.get(ARRIVED)
        dropped = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        if arrived is not None and (arrived["rows"] or dropped):
            out.append((p.batchId, arrived["rows"], dropped))
    return out


def stream_alerts(src: DataFrame, sink: str, alerts_sink: str, recipients: DataFrame, checkpoint: str,
                  hours: int = 8) -> StreamingQuery:
    return stream_ingest(src, sink, checkpoint, hours, alerts_sink, recipients)


def _windowed(src: DataFrame, sink: str, checkpoint: str, length: str, hours: int, stars: bool) -> StreamingQuery:
    aggs = [F.count(F.lit(1)).alias("total_reviews"), F.round(F.avg("review_rating"), 4).alias("average_rating")]
    rows = (_event_time(src, hours)
            .groupBy(F.window("event_time", length, "1 day", LOCAL_MIDNIGHT).alias("w"), "place_name")
            .agg(*aggs, *(star_counts() if stars else [])))
    flat = rows.select("place_name", F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                       F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                       *[c for c in rows.columns if c not in ("w", "place_name")])
    return (flat.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def stream_daily_summary(src: DataFrame, sink: str, checkpoint: str, hours: int = 8) -> StreamingQuery:
    """Per place and local day, written once the watermark has passed the day's end."""
    return _windowed(src, sink, checkpoint, "1 day", hours, stars=True)


def stream_weekly(src: DataFrame, sink: str, checkpoint: str, hours: int = 8) -> StreamingQuery:
    """Per place, the trailing seven local days, moved on daily."""
    return _windowed(src, sink, checkpoint, "7 days", hours, stars=False)


def stream_chat(src: DataFrame, sink: str, checkpoint: str, n: int = 7, parts: int = 64,
                trigger: dict | None = None) -> StreamingQuery:
    """History and routing of a message stream (below ``sink``/out): a row per user message with its intent, and
    per retained message with its history. Each batch is put after the stored tail of its users: their last
    ``n`` retained messages, their last own message that is no small talk (for the feedback state) and their last own
    message (whether the next answer is one to a question). Tails lie in ``parts`` folders by user hash; a batch reads
    and writes those of its own users only, one version on, and removes the version before the one it read, which
    a retry no longer needs."""
    spark = src.sparkSession
    state = StructType(list(src.schema.fields)).add("asked", "boolean").add("kept_for", "string")
    tails = f"{sink}/tails"
    spark.createDataFrame([], state).write.mode("ignore").parquet(f"{tails}/part=-1/batch_id=-1")
    read = StructType(list(state.fields)).add("part", "integer").add("batch_id", "long")
    shape = StructType([src.schema["user"], src.schema["turn"]])
    _seed(spark, shape.add("messages", "integer").add("history", "string").add("intent", "string"), f"{sink}/out")

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch = batch.withColumn("part", F.pmod(F.xxhash64("user"), F.lit(parts)).cast("int")).persist()
        touched = [r["part"] for r in batch.select("part").distinct().collect()]  # at most ``parts``
        versions = (session.read.schema(read).parquet(tails).filter(
            F.col("part").isin(touched) & (F.col("batch_id") < batch_id)).groupBy("part", "batch_id").count().collect())
        newest: dict[int, list[int]] = {}
        for r in versions:
            newest.setdefault(r["part"], []).append(r["batch_id"])
        paths = [f"{tails}/part={p}/batch_id={max(v)}" for p, v in newest.items()]
        old = session.read.schema(state).parquet(*paths) if paths else session.createDataFrame([], state)
        users = batch.select("user").distinct()
        # one row per stored message, though it can be kept for both reasons
        held = F.col("kept_for") == "history"
        here = (old.join(users, "user", "left_semi").groupBy("user", "turn", "role").agg(
            F.max("text").alias("text"), F.max("asked").alias("asked"), F.max(held).alias("held"))
            .withColumn("asked", F.coalesce("asked", F.when(F.col("role") == "user", F.col("held")))))
        talk = conversation(here.unionByName(batch.drop("part").filter(F.col("role").isin("user", "assistant")),
                                             allowMissingColumns=True), n).persist()
        own = F.col("role") == "user"
        shown = talk.join(batch.select("user", "turn"), ["user", "turn"], "left_semi").filter(own | F.col("kept"))
        _write_batch(shown.select("user", "turn", F.size("lines").alias("messages"), F.array_join("lines", "\n").alias("history"),
                                  F.when(own, intent()).alias("intent")), f"{sink}/out", batch_id)

        kept = top_k(talk.filter("kept"), ["user"], [F.col("turn").desc()], n, "_r").select(
            "user", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("boolean").alias("asked"),
            F.lit("history").alias("kept_for"))
        said = talk.filter(own).withColumn("light", F.col("faq").isNotNull())
        last = top_k(said, ["user", "light"], [F.col("turn").desc()], 1, "_r").select(
            "user", "turn", "role", "text", F.col("kept").alias("asked"), F.lit("state").alias("kept_for"))
        rest = old.join(users, "user", "left_anti")
        (rest.unionByName(kept).unionByName(last).withColumn("part", F.pmod(F.xxhash64("user"), F.lit(parts)).cast("int"))
         .withColumn("batch_id", F.lit(batch_id)).repartition("part").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch_id").parquet(tails))
        for p, have in newest.items():
            for spent in sorted(have)[:-1]:
                _drop_path(session, f"{tails}/part={p}/batch_id={spent}")
        for used in (talk, batch):
            used.unpersist()

    return (src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
