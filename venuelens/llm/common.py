"""Helpers shared by the operators: tables, written intermediates, byte-level shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from venuelens.session import fresh_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE = 1 << 20  # bytes of a text handled at once; a longer text goes through in slices


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: lineage is cut, lost executors cost nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(doc_id: Column, text: Column) -> Column:
    """Names the rows of one id and one text; a null id is skipped, so it equals no other id."""
    return F.concat_ws("|", doc_id.cast("string"), F.xxhash64(text).cast("string"))


def ascii_lower(text: Column) -> Column:
    """A-Z only. ``lower`` does the same on pure ASCII and is much faster there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


# --- hashes of words and shingles, vectorised over the UTF-8 bytes ---

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=_U)
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_STEP = _rng.integers(1, 1 << 63, 64, dtype=_U) | _U(1)
_powers = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _grow(n: int) -> None:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=_U)


def _slices(raw: bytes) -> Iterator[np.ndarray]:
    """Pieces that end between words, about ``SLICE`` bytes each (more only for a longer word)."""
    bytes_ = np.frombuffer(raw, np.uint8)
    at = 0
    while at < len(bytes_):
        end = at + SLICE
        while end < len(bytes_):
            gap = np.flatnonzero(_SPACE[bytes_[end:end + SLICE]])
            if len(gap):
                end += int(gap[0])
                break
            end += SLICE
        yield bytes_[at:end]
        at = end


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` in order, A-Z lower-cased. A word's hash is a
    difference of prefix sums times an inverse power, so all words come from one pass over the bytes."""
    out = []
    for raw in _slices(text.encode("utf-8")):
        space = _SPACE[raw]
        edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(start):
            _grow(len(raw) + 1)
            sums = np.zeros(len(raw) + 1, _U)
            np.cumsum(_BYTE[raw] * _powers[0][:len(raw)], out=sums[1:])
            out.append(mix((sums[end] - sums[start]) * _powers[1][start] + (end - start).astype(_U)))
    return np.concatenate(out) if out else np.zeros(0, _U)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; a shorter text is one run; no words, no run."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    width = min(size, len(words))
    runs = np.zeros(len(words) - width + 1, _U)
    for j in range(width):
        runs += words[j:len(words) - width + 1 + j] * _STEP[j]
    return np.unique(mix(runs + _U(width)))
