"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelens.llm.langid import drawn

SAMPLE_ROWS = 3000   # labelled rows that the network is fitted on, half of each label where there are enough
PIECE = 1 << 15      # bytes of a text that are learnt from at once; a longer text is learnt piece by piece
THRESHOLD = 0.7
EMBED, FILTERS, STRIDE = 8, 24, 4   # numbers per byte; learned filters, each over two strides of bytes
BLOCK = 16                          # filter places of a block (64 bytes)
SPAN, HOP = 8, 7                    # blocks of a chunk and from chunk to chunk: chunks of 512 bytes overlap by 64
PART = HOP * BLOCK * STRIDE * 256   # bytes of a text that are held at once
EPOCHS, BATCH, RATE = 14, 32, 0.01
_PAD = 0


@dataclass
class Network:
    embed: np.ndarray    # 256 x EMBED
    first: np.ndarray    # STRIDE * EMBED x FILTERS, the filters' first half
    second: np.ndarray   # and their second half
    bias: np.ndarray     # FILTERS
    out: np.ndarray      # 2 * FILTERS + 1: weights of the largest and of the mean chunk maximum, and a constant

    def places(self, raw: np.ndarray) -> np.ndarray:
        """Filter values at every STRIDE-th byte, cut into whole blocks."""
        blocks = max(1, -(-len(raw) // (STRIDE * BLOCK)))
        padded = np.full((blocks * BLOCK + 1) * STRIDE, _PAD, np.uint8)
        n = min(len(raw), len(padded))
        padded[:n] = raw[:n]
        rows = self.embed[padded].reshape(-1, STRIDE * EMBED)
        return rows[:-1] @ self.first + rows[1:] @ self.second

    def pooled(self, text: str | None) -> np.ndarray:
        """Largest and mean of the chunk maxima of every filter, over the whole text."""
        raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        top, total, count = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS), 0
        for at in range(0, max(1, len(raw)), PART):
            last = at + PART >= len(raw)
            piece = raw[at:at + PART + ((SPAN - HOP) * BLOCK + 1) * STRIDE]
            if at and last and len(piece) <= (SPAN - HOP) * BLOCK * STRIDE:
                break  # the part before it held these bytes already
            value = self.places(piece)
            if not last:  # the places past the part's last chunk only lent their bytes
                value = value[:PART // STRIDE + (SPAN - HOP) * BLOCK]
            chunks = chunk_maxima(value)[0]
            top, total, count = np.maximum(top, chunks.max(axis=0)), total + chunks.sum(axis=0), count + len(chunks)
        relu = lambda v: np.maximum(0, v + self.bias)
        return np.concatenate([relu(top), relu(total / max(1, count))])

    def score(self, text: str | None) -> float:
        z = float(self.pooled(text) @ self.out[:-1] + self.out[-1])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def chunk_maxima(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(maximum, its place) per chunk and filter."""
    blocks = value.reshape(-1, BLOCK, value.shape[1])
    where = blocks.argmax(axis=1)
    best = np.take_along_axis(blocks, where[:, None], axis=1)[:, 0]
    starts = np.arange(0, max(1, len(best) - (SPAN - HOP)), HOP)
    index = np.minimum(starts[:, None] + np.arange(SPAN), len(best) - 1)
    of_chunk = best[index]
    block = of_chunk.argmax(axis=1)
    maxima = np.take_along_axis(of_chunk, block[:, None], axis=1)[:, 0]
    block = np.take_along_axis(index, block, axis=1)
    place = block * BLOCK + np.take_along_axis(where, block, axis=0)
    return maxima, place


def train(texts: list[str], labels: list[int], seed: int = 7) -> Network:
    """Adam on the log loss; gradients go through the places of the maxima only. A text of several pieces gives as
    many examples, which weigh as one together."""
    rng = np.random.default_rng(seed)
    shape = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
    net = Network(shape(256, EMBED, scale=0.5), shape(STRIDE * EMBED, FILTERS, scale=0.2), shape(STRIDE * EMBED, FILTERS, scale=0.2),
                  np.zeros(FILTERS, np.float32), np.append(shape(2 * FILTERS, scale=0.1), 0).astype(np.float32))
    names = ("embed", "first", "second", "bias", "out")
    m = {k: np.zeros_like(getattr(net, k)) for k in names}
    v = {k: np.zeros_like(getattr(net, k)) for k in names}
    raws, y, weight = [], [], []
    for text, label in zip(texts, labels):
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        pieces = np.array_split(raw, max(1, -(-len(raw) // PIECE)))
        raws += pieces
        y += [np.float32(label)] * len(pieces)
        weight += [np.float32(1 / len(pieces))] * len(pieces)
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(raws))
        for at in range(0, len(order), BATCH):
            g = {k: np.zeros_like(getattr(net, k)) for k in names}
            batch = order[at:at + BATCH]
            for i in batch:
                value = net.places(raws[i])
                maxima, place = chunk_maxima(value)
                rows = np.full(((len(value) + 1) * STRIDE,), _PAD, np.uint8)
                rows[:len(raws[i])] = raws[i][:len(rows)]
                top, mean = maxima.max(axis=0) + net.bias, maxima.mean(axis=0) + net.bias
                pooled = np.concatenate([np.maximum(0, top), np.maximum(0, mean)])
                p = 1 / (1 + np.exp(-np.clip(pooled @ net.out[:-1] + net.out[-1], -30, 30)))
                d = (p - y[i]) * weight[i] / len(batch)
                g["out"] += np.append(pooled * d, d)
                back = net.out[:-1] * d * (pooled > 0)
                d_top, d_mean = back[:FILTERS], back[FILTERS:]
                g["bias"] += d_top + d_mean
                share = np.repeat((d_mean / len(maxima))[None], len(maxima), axis=0)
                share[maxima.argmax(axis=0), np.arange(FILTERS)] += d_top
                bytes_ = rows[(place[..., None] * STRIDE + np.arange(2 * STRIDE))]  # chunks x FILTERS x 8
                seen = net.embed[bytes_]
                weights = np.concatenate([net.first.reshape(STRIDE, EMBED, FILTERS), net.second.reshape(STRIDE, EMBED, FILTERS)])
                d_weights = np.einsum("cf,cfje->jef", share, seen)
                g["first"] += d_weights[:STRIDE].reshape(-1, FILTERS)
                g["second"] += d_weights[STRIDE:].reshape(-1, FILTERS)
                d_seen = share[:, :, None, None] * weights.transpose(2, 0, 1)[None]
                flat = d_seen.reshape(-1, EMBED)
                for e in range(EMBED):
                    g["embed"][:, e] += np.bincount(bytes_.ravel(), flat[:, e], 256)
            step += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                setattr(net, k, (getattr(net, k) - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32))
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Network:
    """Learns ``quality`` (0 or 1) of labelled rows that are not held out: about ``sample_rows``, chosen by a hash of
    doc_id alike at every size. Several labels of a document count as their majority, an even split as 1. Null ids
    and null labels or texts are not learnt from. Whole texts are learnt, long ones piece by piece; rows of one doc_id
    with several texts are examples each. Without labels of both kinds the score is that of an untrained network."""
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y")))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = lambda k: drawn(sample_rows // 2, max(1, sizes.get(k, 0)))
    ids = known.filter(F.xxhash64("doc_id") <= F.when(F.col("y") == 1, share(1)).otherwise(share(0)))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    # about sample_rows ids, whatever the size of the tables
    got = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y").collect()
    got.sort(key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in got], [r["y"] for r in got])


def scored(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. Every whole text is read; null and empty
    texts are scored as no bytes. A null doc_id counts as not held out. Only text decides; other columns are not
    read. Repeated rows get equal results; an empty table gives none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [net.score(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, pa.float64()),
                 pa.array([int(s >= threshold) for s in score], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
