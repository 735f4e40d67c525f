"""Near-duplicate groups by b-bit MinHash: band candidates, collision-corrected estimates, exact confirmation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from venuelens.llm.common import mix, shingle_set, stored

BITS = 4        # low bits kept of each minimum
MINIMA = 512    # minima of a signature; the first ones also make the bands
MISS = 1e-7     # chance that a pair at the threshold shares no band
BLOCK = 256     # members of a bucket compared at once
CHUNK = 2048    # shingles hashed at once
_U = np.uint64


def layout(percent: int) -> tuple[int, int]:
    """(bands, rows) for a threshold in percent, so that a pair at the threshold is missed with chance MISS."""
    t = percent / 100
    rows = 5 if t >= 0.84 else 4 if t >= 0.75 else 3
    return math.ceil(math.log(MISS) / math.log1p(-t ** rows)), rows


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(77).integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)


def minima(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    x = (shingles >> _U(32)).astype(np.uint32)
    low = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), CHUNK):
        np.minimum(low, np.multiply.outer(factors, x[at:at + CHUNK]).min(axis=1), out=low)
    return low


def pack(low: np.ndarray) -> bytes:
    """The low bits of each (mixed) minimum, 16 to a 64-bit word; unused places are 0 in every signature."""
    bits = (mix(low.astype(_U)) & _U((1 << BITS) - 1)).astype(np.uint8)
    bits = np.concatenate([bits, np.zeros(-len(bits) % (64 // BITS), np.uint8)])
    return (bits[::2] | bits[1::2] << np.uint8(4)).tobytes()


def estimate(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Similarity of signatures (last axis: 64-bit words), corrected for chance matches of ``BITS`` bits."""
    x = a ^ b
    x |= x >> _U(1)
    x |= x >> _U(2)
    differ = np.bitwise_count(x & _U(0x1111111111111111)).sum(axis=-1, dtype=np.int64)
    chance = 2.0 ** -BITS
    return ((n - differ) / n - chance) / (1 - chance)


def _slack(t: float, n: int) -> float:
    """Four and a half standard deviations of the estimate at the threshold."""
    p = t + (1 - t) * 2.0 ** -BITS
    return 4.5 * math.sqrt(p * (1 - p) / n) / (1 - 2.0 ** -BITS)


def _sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _multipliers(max(MINIMA, bands * rows))
        mult = np.random.default_rng(5).integers(1, 1 << 63, rows, dtype=_U) | _U(1)
        band_no = np.arange(1, bands + 1, dtype=_U) * _U(0xD6E8FEB86659FD93)
        for batch in batches:
            out = {k: [] for k in ("n", "d1", "d2", "bands", "sig")}
            for text in batch.column(1):
                s = shingle_set(text.as_py(), size)
                out["n"].append(len(s))
                if not len(s):
                    for k in ("d1", "d2", "bands", "sig"):
                        out[k].append(None)
                    continue
                low = minima(s, factors)
                out["d1"].append(int(np.bitwise_xor.reduce(mix(s + _U(11))).view(np.int64)))
                out["d2"].append(int(np.add.reduce(mix(s ^ _U(0x5BD1E995))).view(np.int64)))
                key = mix((low[:bands * rows].reshape(bands, rows).astype(_U) * mult).sum(axis=1, dtype=_U) + band_no)
                out["bands"].append(key.view(np.int64))
                out["sig"].append(pack(low))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out["n"], pa.int64()), pa.array(out["d1"], pa.int64()),
                 pa.array(out["d2"], pa.int64()), pa.array(out["bands"], pa.list_(pa.int64())),
                 pa.array(out["sig"], pa.binary())], names=["doc_id", "n", "d1", "d2", "bands", "sig"])

    schema = "doc_id long, n long, d1 long, d2 long, bands array<long>, sig binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, schema)


def _near(pairs: DataFrame, sigs: DataFrame, n: int, floor: float) -> DataFrame:
    """Pairs (a, b) whose estimated similarity reaches ``floor``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), _U).reshape(batch.num_rows, -1)
                        for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array(estimate(a, b, n) >= floor))

    of = lambda name: sigs.select(F.col("doc_id").alias(name), F.col("sig").alias(f"sig_{name}"))
    return (pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sig_a", "sig_b")
            .mapInArrow(run, "a long, b long").distinct())


def _compared(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(a, b, both, either): sizes of the intersection and the union of the full shingle sets of the pairs (a, b)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_text, last = None, None
        for batch in batches:
            both, either = [], []
            for left, right in zip(batch.column(2), batch.column(3)):
                center = right.as_py()
                if center != last_text:  # rows come sorted by the right side, often the same text
                    last_text, last = center, shingle_set(center, size)
                mine = shingle_set(left.as_py(), size)
                both.append(len(np.intersect1d(mine, last, assume_unique=True)))
                either.append(len(mine) + len(last) - both[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(both, pa.int64()), pa.array(either, pa.int64())],
                                             names=["a", "b", "both", "either"])

    texts = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    whole = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return whole.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, both long, either long").distinct()


def _links(compared: DataFrame, percent: int) -> DataFrame:
    return compared.filter((F.col("both") > 0) & (100 * F.col("both") >= percent * F.col("either"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of the edges (a, b), component being its smallest node. Large and small
    star steps alternate until nothing changes; each step aggregates before it shuffles."""
    def step(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = pairs.join(least, "a")
        if large:
            moved = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = (moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
                     .unionByName(least.select("a", F.col("m").alias("b"))))
        return moved.filter("a <> b").distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    pairs = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .filter("a <> b").distinct(), "links")
    before = state(pairs)
    while before[0]:
        pairs = stored(step(step(pairs, True), False), "links")
        now = state(pairs)
        if now == before:
            break
        before = now
    return (pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))


def _stars(members: DataFrame) -> DataFrame:
    """(a, b): each document with one partner. A bucket's center is the member that meets most others over all its
    buckets: the document that a group was copied from rather than one of its copies. Of several centers, the
    one with most shared buckets is the partner."""
    met = members.groupBy("doc_id").agg(F.sum("m").alias("met"))
    centers = (members.join(met, "doc_id").groupBy("key")
               .agg(F.max(F.struct("met", (-F.col("doc_id")).alias("c")))["c"].alias("c")))
    return (members.join(centers, "key").filter("doc_id <> -c").groupBy("doc_id", "c").agg(F.count(F.lit(1)).alias("k"))
            .groupBy("doc_id").agg(F.max(F.struct("k", "c"))["c"].alias("c"))
            .select(F.col("doc_id").alias("a"), (-F.col("c")).alias("b")))


def _residual(members: DataFrame, reps: DataFrame, label: DataFrame, stars: DataFrame, percent: int, n: int,
              floor: float) -> DataFrame:
    """Near pairs of one bucket that lie in different components so far. Only members outside a bucket's main
    component are held against all members, block by block, so no task holds a bucket. A pair is left out where
    its set sizes or, as 1 - similarity is a metric, the known distances of both to one partner rule a link
    out; one that shares several buckets comes from the first only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = 1 - percent / 100 + 1e-9
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                key = batch.column(0)[row].as_py()
                few, all_ = ([x.to_numpy(zero_copy_only=False) if i != 3 and i != 4 else x for i, x in
                              enumerate(batch.column(c)[row].values.flatten())] for c in (1, 2))
                sig = [np.frombuffer(b"".join(x[3].to_pylist()), _U).reshape(len(x[0]), -1) for x in (few, all_)]
                bands = [x[4].flatten().to_numpy().reshape(len(x[0]), -1) for x in (few, all_)]
                of = lambda k: (few[k][:, None], all_[k][None])
                (comp_a, comp_b), (n_a, n_b), (by_a, by_b), (d_a, d_b) = of(1), of(2), of(5), of(6)
                hit = (comp_a != comp_b) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))
                hit &= ~((by_a == by_b) & (np.abs(d_a - d_b) > far))  # an unknown partner is NaN, equal to nothing
                hit &= estimate(sig[0][:, None], sig[1][None], n) >= floor
                i, j = np.nonzero(hit)
                same = bands[0][i] == bands[1][j]
                first = same.any(axis=1) & (np.take_along_axis(bands[0][i], same.argmax(axis=1)[:, None], 1)[:, 0] == key)
                a, b = few[0][i[first]], all_[0][j[first]]
                found.append(np.stack([np.maximum(a, b), np.minimum(a, b)]))
            if found:
                a, b = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    known = members.join(label.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
    per_comp = known.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    buckets = per_comp.groupBy("key").agg(
        F.sum("m").alias("m"), F.count(F.lit(1)).alias("comps"),
        F.max(F.struct("m", "comp"))["comp"].alias("main")).filter("comps > 1")
    # distance to the partner; a document of several sets has several rows there, and then none is used
    distance = stars.groupBy("a").agg(
        F.count(F.lit(1)).alias("rows"), F.min("b").cast("double").alias("partner"),
        (1 - F.min("both") / F.min("either")).alias("distance")).filter("rows = 1").select(
        F.col("a").alias("doc_id"), "partner", "distance")
    rows = (known.join(buckets, "key").join(reps, "doc_id").join(distance, "doc_id", "left")
            .withColumn("blk", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("m") / BLOCK))))
    packed = F.collect_list(F.struct("doc_id", "comp", "n", "sig", "bands", F.coalesce("partner", F.lit(float("nan"))).alias("partner"),
                                     F.coalesce("distance", F.lit(0.0)).alias("distance")))
    all_ = rows.groupBy("key", "blk").agg(packed.alias("all"))
    few = rows.filter("comp <> main").groupBy("key", F.col("blk").alias("few_blk")).agg(packed.alias("few"))
    return few.join(all_, "key").select("key", "few", "all").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents whose sets of distinct ``size``-word shingles have 100 * intersection >= percent * union are linked;
    component_id is the smallest doc_id reachable. Equal sets are one class, and only a class's smallest doc_id
    goes on, so copies never meet in pairs. Each member of a band bucket is first held against one partner, the
    member that meets most others; later only pairs that the found groups leave open are held against each other. Every link is confirmed on the full sets.

    Null or wordless text: n_shingles 0, its own component, kept. Null doc_id: component_id null, kept true, and it
    links nothing. Rows that share a doc_id are one document with several sets; a repeated row repeats its result.
    Other columns are not read. An empty table gives no rows.
    """
    bands, rows = layout(percent)
    n = max(MINIMA, bands * rows)
    floor = percent / 100 - _slack(percent / 100, n)
    sketch = stored(_sketches(docs, size, bands, rows), "sketches")
    named = sketch.filter("doc_id is not null and d1 is not null")
    classes = named.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    reps = stored(named.join(classes.withColumnRenamed("rep", "doc_id"), ["d1", "d2", "doc_id"])
                  .dropDuplicates(["doc_id", "d1", "d2"]).select("doc_id", "n", "bands", "sig"), "class-sketches")
    keys = reps.select("doc_id", F.explode_outer("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = stored(keys.join(shared, "key").select("key", "doc_id", "m"), "bucket-members")
    sigs = reps.select("doc_id", "sig")
    stars = _near(_stars(members), sigs, n, min(floor, 0.5))
    first = stored(_compared(stars, docs, size), "star-pairs")
    label = components(_links(first, percent))
    open_pairs = stored(_residual(members.select("key", "doc_id"), reps, label, first, percent, n, floor), "open-pairs")
    second = _compared(open_pairs, docs, size)
    label = components(_links(first, percent).unionByName(_links(second, percent)))
    whole = (sketch.join(classes, ["d1", "d2"], "left")
             .join(label.withColumnRenamed("node", "rep"), "rep", "left"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, less near copies: each group keeps the row of its smallest doc_id. Rows of
    one doc_id with different texts are documents of their own: the text of the smallest hash stands for the id, the
    others rank behind all ids. Of rows equal in doc_id and text one stays. Rows with a null doc_id stay."""
    named = docs.filter(F.col("doc_id").isNotNull())
    text_hash = F.xxhash64("text")
    several = stored(named.groupBy(F.col("doc_id").alias("__id")).agg(F.min(text_hash).alias("__first"), F.max(text_hash).alias("__last"))
                     .filter("__first <> __last").select("__id", "__first"), "ids-with-several-texts")
    other = F.shiftrightunsigned(F.xxhash64("doc_id", text_hash, F.lit(1)), 2).bitwiseOR(F.lit(1 << 62))
    node = F.when(F.col("__first").isNull() | (F.col("__first") == text_hash), F.col("doc_id").cast("long")).otherwise(other)
    nodes = named.join(several, F.col("doc_id") == F.col("__id"), "left").withColumn("__node", node).drop("__id", "__first")
    gone = (near_duplicates(nodes.select(F.col("__node").alias("doc_id"), "text"), size, percent)
            .filter("not kept").select(F.col("doc_id").alias("__gone")).distinct())
    left = nodes.join(gone, F.col("__node") == F.col("__gone"), "left_anti")
    one = left.withColumn("__rank", F.row_number().over(Window.partitionBy("__node").orderBy(text_hash)))
    return one.filter("__rank = 1").drop("__rank", "__node").unionByName(docs.filter(F.col("doc_id").isNull()))
