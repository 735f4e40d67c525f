"""Exact top-k inner-product search over an inverted index by MaxScore."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelens.llm.common import stored
from venuelens.operators.skew import top_k

SHARD = 4096    # vectors of a shard of the index
QUERIES = 256   # queries that meet a shard at once
STRIDE = 512    # vectors of a shard between two looks at the threshold


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) per component, null where the vector or a component is null or not finite."""
    whole = F.size(embedding) > 0
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(whole & good, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def _arrays(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    ids, vectors = rows.values.flatten()
    return ids.to_numpy(), vectors.flatten().to_numpy().reshape(len(ids), -1)


def _search(shard: pa.ListScalar, queries: pa.ListScalar, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query_id, vec_ids, scores): a shard's first ``k`` vectors for each query.

    A term is a component, its postings are the vectors where it is not 0, and its bound for a query is the most it
    can add. While the shard is read in strides, the terms whose bounds together stay below the k-th best score are
    non-essential: only vectors in the postings of the others are scored, and they are probed on with the
    non-essential terms, highest bound first, for as long as their bounds let them reach that score."""
    (ids, rows), (asked_ids, asked) = _arrays(shard), _arrays(queries)
    if rows.shape[1] * float(np.abs(rows).max()) * float(np.abs(asked).max()) < 2.0 ** 53:
        rows, asked = rows.astype(np.float64), asked.astype(np.float64)  # sums stay exact, products are faster
    order = np.argsort(ids, kind="stable")  # so that ties go to the smaller id
    ids, rows = ids[order], rows[order]
    postings = np.ascontiguousarray(rows.T)
    high, low = postings.max(axis=1), postings.min(axis=1)
    filled = postings != 0
    dense = filled.reshape(len(postings), -1).all(axis=1)
    for query_id, q in zip(asked_ids, asked):
        bound = np.maximum(0, np.maximum(q * high, q * low))
        by_bound = np.argsort(-bound, kind="stable")
        rest = np.concatenate([np.cumsum(bound[by_bound][::-1])[::-1], [0]])  # most that terms from i on can add
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, rows.dtype)
        for at in range(0, len(ids), STRIDE):
            span = slice(at, min(at + STRIDE, len(ids)))
            if len(best) < k:
                essential = len(by_bound)
                live = np.arange(span.start, span.stop)
            else:
                essential = int(np.argmax(rest < best[-1])) if rest[-1] < best[-1] else len(by_bound)
                terms = by_bound[:essential]
                if essential == 0:
                    continue
                if essential == len(by_bound) or dense[terms].any():
                    live = np.arange(span.start, span.stop)
                else:
                    live = np.flatnonzero(filled[terms, span].any(axis=0)) + span.start
            terms = by_bound[:essential]
            score = q[terms] @ postings[terms, span]
            if len(live) < len(score):
                score = score[live - span.start]
            for i in range(essential, len(by_bound), 4):  # four terms a probe
                alive = score + rest[i] >= best[-1]
                if not alive.all():
                    live, score = live[alive], score[alive]
                if not len(live):
                    break
                probe = by_bound[i:i + 4]
                score = score + q[probe] @ postings[probe[:, None], live[None]]
            own = ids[live] == query_id
            best_ids = np.concatenate([best_ids, ids[live][~own]])
            best = np.concatenate([best, score[~own]])
            if len(best) > k:
                first = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[first], best[first]
            elif len(best):
                first = np.lexsort((best_ids, -best))
                best_ids, best = best_ids[first], best[first]
        if len(best):
            yield query_id, best_ids, best


def search(candidates: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` candidates (vec_id, vec array<long>) with the largest integer
    inner product for each query (vec_id, vec); ties go to the smaller vec_id. A query is no candidate of its own id.

    Candidates lie in shards of about ``shard_rows`` by hash; blocks of queries go to every shard and each sends back
    at most ``k`` rows per query, which are merged. A null id or vector takes no part. Each of several equal rows is a
    candidate (they are counted, and the ``k`` of them that can be among the best are held); of several vectors under
    one query id the smallest is asked. Vectors must have one length: those of another length than a
    query's are no candidates for it. A query without candidates has no rows; empty tables give none.
    """
    index = candidates.filter("vec_id is not null and vec is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), "vec", F.size("vec").alias("dim"))
    index = (index.groupBy("vec_id", "vec", "dim").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies"))
             .withColumn("copy", F.explode_outer(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy"))
    sizes = index.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    shards = index.join(sizes.withColumn("shards", F.ceil(F.col("n") / shard_rows)), "dim").withColumn(
        "shard", F.pmod(F.xxhash64("vec_id", "vec"), F.col("shards")))
    index_rows = stored(shards.groupBy("dim", "shard").agg(
        F.collect_list(F.struct("vec_id", "vec")).alias("rows")), "index-shards")
    asked = (queries.filter("vec_id is not null and vec is not null")
             .groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("vec").alias("vec"))
             .withColumn("dim", F.size("vec")))
    n_blocks = max(1, math.ceil(asked.count() / QUERIES))
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(n_blocks))).groupBy("dim", "block").agg(
        F.collect_list(F.struct("vec_id", "vec")).alias("asked"))
    every_shard = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / shard_rows) - 1)
    met = (blocks.join(sizes, "dim").select("dim", F.explode_outer(every_shard).alias("shard"), "asked")
           .join(index_rows, ["dim", "shard"]).select("rows", "asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                found = list(_search(batch.column(0)[at], batch.column(1)[at], k))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]), pa.int64()),
                         pa.array(np.concatenate([f[1] for f in found]), pa.int64()),
                         pa.array(np.concatenate([f[2] for f in found]).astype(np.int64))],
                        names=["query_id", "vec_id", "score"])

    parts = met.mapInArrow(run, "query_id long, vec_id long, score long")
    return top_k(parts, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
