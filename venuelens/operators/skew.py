"""Building blocks that stay whole and balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuelens.session import shared_dir


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key. Spark pushes the row-number limit below the
    shuffle, so each map task sends at most ``k`` rows of a hot key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the lowest ``order`` per key; copies of a hot key are dropped before the shuffle.
    The key must not be null: rows without one are no copies of each other."""
    return top_k(df, [key], [F.col(order)], 1, "_first").drop("_first")


def numbered(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (),
             out: str = "row_no") -> DataFrame:
    """Row numbers 1.. per ``keys`` in ``order`` (which must be unique within a key)
    without one task per key: range sort, count per range, add the counts before it.
    The sorted rows are checkpointed, as both uses must see the same ranges."""
    shared_dir(df.sparkSession)
    sort_by = [*keys, *order]
    placed = (df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
              .withColumn("_part", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id())
              .checkpoint())
    pieces = placed.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"),
                                                F.min("_pos").alias("_start"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .select("_part", *keys, "_start", "_before"))
    if not keys:
        # one row per range partition of this very job, so its size is bounded
        joined = placed.join(F.broadcast(offsets), "_part")
    else:
        same = placed["_part"] == offsets["_part"]
        for key in keys:
            same = same & placed[key].eqNullSafe(offsets[key])
        joined = placed.join(offsets, same).select(placed["*"], "_start", "_before")
    return (joined.withColumn(out, F.col("_before") + F.col("_pos") - F.col("_start") + 1)
            .select(*df.columns, out))


def with_carry(df: DataFrame, key: str, order: str, n: int, block: int,
               relevant: Column | None = None) -> DataFrame:
    """Adds ``_block`` and ``_carried``. Rows are cut into blocks of ``block`` consecutive
    ``order`` values, and each block that has a predecessor also gets copies of the last ``n``
    (relevant) rows before it, marked ``_carried``. A window over (key, _block) then
    sees what it would see over the key alone, while no task holds more than a block."""
    blocked = (df.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
               .withColumn("_carried", F.lit(False)))
    # one row per block of the keys with several; joins and windows below are on (key, block),
    # never on the key alone, so that a long key stays spread
    blocks = blocked.groupBy(key, "_block").agg(F.min(order).alias(order))
    marks = (blocks.withColumn("_blocks", F.count(F.lit(1)).over(Window.partitionBy(key)))
             .filter(F.col("_blocks") > 1).drop("_blocks").withColumn("_mark", F.lit(True)))
    long = blocked.join(marks.select(key, "_block"), [key, "_block"], "left_semi")
    usable = long if relevant is None else long.filter(relevant)
    tails = top_k(usable, [key, "_block"], [F.col(order).desc()], n, "_rank").drop("_rank")
    line = tails.withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    # number the tail rows along the key; a marker stands before the rows of its own block
    so_far = (Window.partitionBy(key).orderBy("_block", F.col("_mark").desc(), order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    line = line.withColumn("_no", F.count(F.when(~F.col("_mark"), 1)).over(so_far))
    wanted = line.filter("_mark").select(
        F.col(key), F.col("_block").alias("_to"),
        F.explode(F.sequence(F.col("_no") - (n - 1), F.col("_no"))).alias("_no"))
    ghosts = (line.filter("not _mark").drop("_block").join(wanted, [key, "_no"])
              .select(*df.columns, F.col("_to").alias("_block"), F.lit(True).alias("_carried")))
    return blocked.unionByName(ghosts)
