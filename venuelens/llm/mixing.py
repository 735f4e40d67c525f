"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuelens.llm.common import stored

WEIGHTS = (5, 2, 1)   # by code point order of the sources, repeating
SHARE = 1.5           # words of the mix to words of all documents
REPEATS = 2           # a source is taken at most so many times
TILTS = (-0.6, 0.0, 0.6)  # slope of a source's weight over training, by the same order
PIECE = 50_000        # rows of a source that are summed along at once
COPIES = 100_000      # equal rows that are listed at once
WORD_RUN = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RUN)), F.lit(0)).cast("long")


def _cycle(position: Column, values: Sequence[float]) -> Column:
    return F.get(F.array(*[F.lit(float(x)) for x in values]), F.pmod(position - 1, F.lit(len(values))))


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   repeats: float = REPEATS) -> DataFrame:
    """source, source_size, n_docs, place, target. Targets share ``share`` of all words by weight and stop at
    ``repeats`` times their source; what is over is shared again by weight. The sources that stop are those of the
    smallest size for their weight, so running sums in that order tell the level at which sharing ends. One row
    per source, so the windows see no more than that."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = (sums.withColumn("place", F.row_number().over(order))
         .withColumn("weight", _cycle(F.col("place"), weights))
         .withColumn("cap", F.col("source_size") * F.lit(float(repeats))))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = (s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
         .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(filled), F.lit(0.0)))
         .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0)))
         .withColumn("stops", F.col("cap") * F.col("open") <= F.col("weight") * F.col("left")))
    stopped = F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0.0)).over(everything)
    free = F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("weight"))).over(everything)
    level = F.col("weight") * (F.col("total") - stopped) / free
    return s.withColumn("target", F.when(F.col("stops"), F.col("cap")).otherwise(level)).select(
        "source", "source_size", "n_docs", "place", "target")


def schedule_inverse(fraction: Column, tilt: Column) -> Column:
    """Training time in [0, 1] at which a source has used ``fraction`` of its demand. Its weight over time is
    1 + tilt * (2t - 1), so its demand up to t is tilt * t^2 + (1 - tilt) * t; this is the root of that."""
    b = 1 - tilt
    root = (F.sqrt(b * b + 4 * tilt * fraction) - b) / (2 * tilt)
    return F.least(F.lit(1.0), F.when(F.abs(tilt) < 1e-9, fraction).otherwise(root))


def _passes(docs: DataFrame, weights: Sequence[float], share: float, repeats: float, tilts: Sequence[float], piece: int) -> DataFrame:
    """A row per row of ``docs``: doc_id, size, source_size, target, text_hash, and ``passes``, an array of (taken,
    position): one entry for each time that words of the document are taken.

    Equal rows are counted before anything is dealt out, so a row that is repeated very often is one row in the sums."""
    doc_id, text_hash = F.col("doc_id").cast("long"), F.xxhash64("text")
    sized = stored(docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
                               text_hash.alias("text_hash")).groupBy("doc_id", "source", "size", "text_hash").agg(F.count(F.lit(1)).alias("n")), "sizes")
    words = F.col("size") * F.col("n")
    targets = source_targets(sized.select("source", words.alias("size")), weights, share, repeats)
    low = F.lit(1 << 28)
    at = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id"), F.col("text_hash")).cast("string")), 1, 7), 16, 10).cast("long")
    spread = (sized.join(targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
              .withColumn("at", at)
              .withColumn("piece", F.floor(F.col("at") * F.ceil(F.col("n_docs") / piece) / low)))
    sums = spread.groupBy("place", "piece").agg(F.sum(words).alias("words"))
    before = Window.partitionBy("place").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("place", "piece", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = (Window.partitionBy("place", "piece").orderBy("at", "doc_id", "text_hash")
              .rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("offset") + F.coalesce(F.sum(words).over(inside), F.lit(0))
    rows = spread.join(offsets, ["place", "piece"]).withColumn("start", start)
    # equal rows stand one after another; the list of their numbers is made in bounded pieces
    rows = (rows.withColumn("block", F.explode_outer(F.sequence(F.lit(0), F.col("n") - 1, F.lit(COPIES))))
            .withColumn("copy", F.explode_outer(F.sequence("block", F.least(F.col("block") + COPIES, F.col("n")) - 1)))
            .withColumn("start", F.col("start") + F.col("copy") * F.col("size")))
    goal = F.round("target").cast("long")
    rounds = F.floor(goal / F.greatest("source_size", F.lit(1)))
    tilt = _cycle(F.col("place"), tilts)

    def one(number: Column) -> Column:
        begin = number * F.col("source_size") + F.col("start")
        return F.struct(F.least("size", F.greatest(F.lit(0), goal - begin)).alias("taken"),
                        schedule_inverse(begin / F.greatest(goal, F.lit(1)), tilt).alias("position"))

    passes = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), rounds), one), lambda x: x["taken"] > 0)
    return rows.select("doc_id", "size", "source_size", "target", "text_hash", passes.alias("passes"))


def occurrences(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS,
                tilts: Sequence[float] = TILTS, piece: int = PIECE) -> DataFrame:
    """The mix itself, one row for each time that words of a row of ``docs`` are taken, range-sorted by position:
    doc_id, text_hash, occurrence (from 1), taken (words), position. Other rules as in ``mixed``, whose taken is the
    sum over a row's occurrences; rows of which nothing is taken have none."""
    rows = _passes(docs, weights, share, repeats, tilts, piece)
    return (rows.select("doc_id", "text_hash", F.posexplode("passes").alias("occurrence", "p"))
            .select("doc_id", "text_hash", (F.col("occurrence") + 1).alias("occurrence"), "p.taken", "p.position")
            .orderBy("position", "doc_id", "text_hash", "occurrence"))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS,
          tilts: Sequence[float] = TILTS, piece: int = PIECE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source), sorted by position: doc_id, size, source_size, target,
    taken, position, positions, text_hash.

    The documents of a source follow each other in the order of a hash, again and again; the words of this run
    are cut at the source's target, so the last document may be taken in part. taken counts its words with
    repeats; positions are the training times at which its words come, one for each time it is taken: the source's
    cumulative demand (its weight schedule, integrated) inverted. position is the first of them. Documents of which
    nothing is taken come last, with a null position.

    Hashes and integer sums only: reruns agree. A null source is a source; null or wordless text has size 0 and
    is never taken; a null doc_id is a document like others; repeated rows are documents of their own. Other
    columns are not read. An empty table gives no rows.
    """
    rows = _passes(docs, weights, share, repeats, tilts, piece)
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda total, p: total + p["taken"])
    return (rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.get("passes.position", F.lit(0)).alias("position"),
                        F.col("passes.position").alias("positions"), "text_hash")
            .orderBy(F.col("position").asc_nulls_last(), "doc_id", "text_hash"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which the mix takes words, all columns, with taken, position and positions (one for
    each time a row is taken), range-sorted by position. Rows of one id and text get one row's figures. Columns of
    these names that ``docs`` has itself are kept as ``own_taken`` and so on. An empty table gives no rows."""
    added = ("taken", "position", "positions")
    for name in added:
        if name in docs.columns:
            new = f"own_{name}"
            while new in docs.columns:
                new = f"own_{new}"
            docs = docs.withColumnRenamed(name, new)
    mix = (mixed(docs).filter("taken > 0").groupBy("doc_id", "text_hash")
           .agg(F.min(F.struct((-F.col("taken")).alias("less"), "position", "positions")).alias("__m"))
           .select(F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__text_hash"), "__m"))
    same = docs["doc_id"].eqNullSafe(mix["__doc_id"]) & (F.xxhash64(docs["text"]) == mix["__text_hash"])
    return (docs.join(mix, same).orderBy("__m.position", "doc_id")
            .select(*[docs[c] for c in docs.columns], (-F.col("__m.less")).alias("taken"),
                    *[F.col(f"__m.{name}").alias(name) for name in added[1:]]))
