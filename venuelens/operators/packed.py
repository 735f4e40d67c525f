"""Counts of many texts in few bytes: a task's counts leave it packed, many texts to a row."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

HELD_BYTES = 64 << 20  # of texts, counted before they are packed
HELD_ROWS = 1_000_000  # unpacked before they are added up
OUT_ROWS = 10_000
_CODEC = "zstd"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PREFIX = np.arange(8)
_NEAR = 1e-5  # log ratios nearer than this may be equal once they are rounded to six digits


def telling_texts(rows: DataFrame, key: str, texts: str, flag: str, pieces: int, name: str, best: int) -> DataFrame:
    """For each ``key`` and text of the arrays ``texts``: in how many rows it stands whose ``flag`` is 1, as ``pos``, and 0, as
    ``neg``. An array holds a text once; a null key's are left out. Each of ``pieces`` counts its texts over all tasks, and leaves
    out those that ``best`` others of the key surely precede, by the ratio of ``pos + 1`` to ``neg + 1`` from either end; of equal
    counts the first texts precede."""
    parts = rows.filter(rows[key].isNotNull()).select(key, flag, texts).mapInArrow(
        _packing(pieces), "piece int, keys array<string>, n int, size bigint, packed binary")
    return parts.groupBy("piece").applyInArrow(_adding(key, name, best), f"`{key}` string, `{name}` string, pos bigint, neg bigint")


def _packing(pieces: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            key, flag, texts = batch.columns
            row = pc.list_parent_indices(texts)
            positive = flag.take(row).cast(pa.int64())
            held.append(pa.table({"key": key.take(row).cast(pa.large_string()), "text": pc.list_flatten(texts).cast(pa.large_string()),
                                  "pos": positive, "neg": pc.subtract(1, positive)}))
            size += held[-1].nbytes
            if size > HELD_BYTES:
                yield from _pack(_added(held), pieces)
                held, size = [], 0
        if held:
            yield from _pack(_added(held), pieces)
    return run


def _added(tables: list[pa.Table]) -> pa.Table:
    """One row a key and text; the tables are let go. They are told apart as numbers, which is much faster than grouping by strings."""
    rows = pa.concat_tables(tables).combine_chunks()
    tables.clear()
    if not len(rows):
        return rows
    key, text = (rows[c].chunk(0).dictionary_encode() for c in ("key", "text"))
    rows = rows.select(["pos", "neg"])
    pair = key.indices.to_numpy().astype(np.int64) * len(text.dictionary) + text.indices.to_numpy()
    found, at = np.unique(pair, return_inverse=True)
    sums = {c: np.bincount(at, rows[c].to_numpy(), len(found)).astype(np.int64) for c in ("pos", "neg")}
    return pa.table({"key": key.dictionary.take(pa.array(found // len(text.dictionary))),
                     "text": text.dictionary.take(pa.array(found % len(text.dictionary))), **sums})


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets, from 0, and the bytes of texts."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return at - at[0], np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)


def _piece(texts: pa.Array, of_key: np.ndarray, pieces: int) -> np.ndarray:
    """By key and the first eight bytes: alike texts stay together, which packs well, and a frequent word is spread."""
    at, data = _bytes(texts)
    there = _PREFIX < np.diff(at)[:, None]
    prefix = np.zeros(there.shape, np.uint8)
    prefix[there] = data[(at[:-1, None] + _PREFIX)[there]]
    mixed = (prefix.view("<u8")[:, 0] ^ of_key) * _MIX
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
    return ((mixed >> np.uint64(32)) % np.uint64(pieces)).astype(np.int32)


def _planes(values: np.ndarray) -> bytes:
    """The lowest bytes of all values, then the next: the higher ones are mostly 0."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _pack(sums: pa.Table, pieces: int) -> Iterator[pa.RecordBatch]:
    if not len(sums):
        return
    text, coded = sums["text"].chunk(0), sums["key"].chunk(0).dictionary_encode()
    names = coded.dictionary.to_pylist()
    of_key = np.array([zlib.crc32(k.encode()) for k in names], np.uint64) * _MIX
    codes = coded.indices.to_numpy()
    piece = _piece(text, of_key[codes], pieces)
    order = pc.sort_indices(pa.table({"piece": piece, "code": codes, "text": text}),
                            [("piece", "ascending"), ("code", "ascending"), ("text", "ascending")])
    piece, codes = piece[o := order.to_numpy()], codes[o]
    pos, neg = (sums[c].to_numpy()[o] for c in ("pos", "neg"))
    at, data = _bytes(text.take(order))
    codec, out = pa.Codec(_CODEC, compression_level=1), []
    ends = [*np.flatnonzero(np.diff(piece)) + 1, len(piece)]
    for a, b in zip([0, *ends], ends):
        used, own = np.unique(codes[a:b], return_inverse=True)
        whole = b"".join([*map(_planes, (own, np.diff(at[a : b + 1]), pos[a:b], neg[a:b])), data[at[a] : at[b]].tobytes()])
        out.append((int(piece[a]), [names[c] for c in used], int(b - a), len(whole), codec.compress(whole, asbytes=True)))
    for i in range(0, len(out), OUT_ROWS):
        columns = zip(*out[i : i + OUT_ROWS])
        kinds = (pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["piece", "keys", "n", "size", "packed"])


def _unpacked(keys: list[str], n: int, size: int, packed: bytes) -> pa.Table:
    whole = pa.Codec(_CODEC).decompress(packed, size, asbytes=True)
    code, length, pos, neg = (np.ascontiguousarray(np.frombuffer(whole, np.uint8, 8 * n, 8 * n * i).reshape(8, n).T).view("<i8")[:, 0] for i in range(4))
    at = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    text = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(at), pa.py_buffer(whole[32 * n :])])
    return pa.table({"key": pa.array(keys, pa.large_string()).take(pa.array(code)), "text": text, "pos": pos, "neg": neg})


def _first(sums: pa.Table, best: int) -> pa.Table:
    """Without the rows that at least ``best`` of their key precede, from both ends."""
    key = sums["key"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    (of_pos, pos), (of_neg, neg) = (np.unique(sums[c].to_numpy(), return_inverse=True) for c in ("pos", "neg"))
    # rows of a key with the same counts are one kind; there are few
    kinds, kind, rows = np.unique((key * len(of_pos) + pos) * len(of_neg) + neg, return_inverse=True, return_counts=True)
    start = kinds // (len(of_pos) * len(of_neg)) * 1000.0
    ratio = np.log((of_pos[kinds // len(of_neg) % len(of_pos)] + 1) / (of_neg[kinds % len(of_neg)] + 1))
    near = np.zeros(len(kinds), bool)
    for at in (start - ratio, start + ratio):
        line = np.sort(at)
        before = np.concatenate([[0], np.cumsum(rows[np.argsort(at)])])
        near |= before[np.searchsorted(line, at - _NEAR)] - before[np.searchsorted(line, start - 500)] < best
    some = np.flatnonzero(near[kind])
    few = pa.table({"kind": kind[some], "text": sums["text"].take(pa.array(some)), "row": some})
    few = few.take(pc.sort_indices(few, [("kind", "ascending"), ("text", "ascending")]))
    of_kind = few["kind"].to_numpy()
    nth = np.arange(len(of_kind)) - np.searchsorted(of_kind, of_kind)
    return sums.take(pa.array(few["row"].to_numpy()[nth < best]))


def _adding(key: str, name: str, best: int) -> Callable[[pa.Table], pa.Table]:
    def run(parts: pa.Table) -> pa.Table:
        held, new, most = [], 0, HELD_ROWS
        for batch in parts.to_batches(max_chunksize=100):
            for part in batch.to_pylist():
                held.append(_unpacked(part["keys"], part["n"], part["size"], part["packed"]))
                new += part["n"]
                if new > most:
                    held = [_added(held)]
                    new, most = 0, max(HELD_ROWS, len(held[0]))
        kinds = pa.schema([(key, pa.string()), (name, pa.string()), ("pos", pa.int64()), ("neg", pa.int64())])
        sums = _first(_added(held), best).rename_columns(kinds.names)
        return pa.Table.from_batches(sums.to_batches(max_chunksize=OUT_ROWS), sums.schema).cast(kinds)
    return run
