"""Public tokenizers inside Spark tasks: each distinct run of a text is encoded once, by the library itself.

A text is cut at single spaces between two characters that are no white space. Both tokenizers always end a token
there and look at nothing beyond, so the runs' ids, one after the other, are the ids of the whole text. Runs are
Zipfian, so most come from a table of the worker process. Where only byte-level ids are asked for, ``pieces`` cuts
finer, at every place where the pattern of that tokenizer surely ends a word, over the bytes of many texts at once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

GAP = re.compile(r" (?=\S)(?<=\S )")  # Python's white space contains that of the tokenizers
SLICE = 1 << 20      # characters of a text that are cut into runs at once
BATCH = 1 << 20      # characters of the texts that are encoded together
LONGEST_KEPT = 64    # longer runs are encoded each time
KEPT = 300_000       # runs that a worker remembers
JOINED = 2000        # runs that the library encodes as one text


def runs(text: str) -> Iterator[list[str]]:
    """The runs of a text in order, without the spaces between them, a slice of the text at a time."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + SLICE)
        yield GAP.split(text[at:gap.start() if gap else len(text)])
        at = gap.end() if gap else len(text)


def byte_table() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable Latin-1 characters stand for themselves, the
    other bytes for 256, 257, … in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """Values of runs, computed for many missing ones together. Short ones are remembered in two generations of about
    half of ``KEPT``: a full one becomes the old one, and a run met there moves to the young one, so often met runs stay."""

    def __init__(self, compute: Callable[[list[str]], Iterable[tuple[str, object]]]):
        self.compute, self.young, self.old = compute, {}, {}

    def of(self, wanted: list[str]) -> list:
        """The value of each wanted run; they differ."""
        if len(self.young) > KEPT // 2:
            self.young, self.old = {}, self.young
        values = list(map(self.young.get, wanted))
        places = [i for i, v in enumerate(values) if v is None]
        met = {wanted[i]: self.old.get(wanted[i]) for i in places}
        missing = [r for r, v in met.items() if v is None]
        if missing:
            met.update(self.compute(missing))
        for i in places:
            values[i] = met[wanted[i]]
        self.young.update((r, v) for r, v in met.items() if len(r) <= LONGEST_KEPT)
        return values


def spaced(text: str) -> list[str]:
    """The runs of a text, each but the first with the space before it: together they are the text."""
    out = [" " + run for part in runs(text) for run in part]
    return [out[0][1:], *out[1:]] if out else []


# --- places where the byte-level pattern ends a word, whatever stands before or after ---
#
# The pattern is '(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+ and never looks back. So a word
# ends between characters of two kinds, but for an apostrophe before a letter; before white space; before the last white
# space ahead of another character; and behind it, but for a space, which goes with what follows. Only bytes whose kind
# is sure have one: ASCII, and the letters U+00C0 to U+01FF and U+0400 to U+047F. At others the text stays whole.

PATTERN = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
OTHER, LETTER, DIGIT, MARK, APOSTROPHE, WHITE, MAYBE_WHITE = range(7)
KIND = np.full(256, OTHER, np.uint8)
KIND[0x21:0x7F] = MARK
KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = LETTER
KIND[ord("0"):ord("9") + 1] = DIGIT
KIND[ord("'")] = APOSTROPHE
KIND[[0x20, *range(0x09, 0x0E)]] = WHITE
KIND[0x1C:0x20] = MAYBE_WHITE
LETTER_LEADS = np.zeros(256, bool)
LETTER_LEADS[[*range(0xC3, 0xC8), 0xD0, 0xD1]] = True  # of two bytes, all letters but U+00D7 and U+00F7
WHITE_STARTS = (0xC285, 0xC2A0, 0xE19A, 0xE1A0, 0xE280, 0xE281, 0xE380)  # first two bytes of all white space beyond ASCII
ENDS = np.zeros((7, 7), bool)  # whether a word ends between two kinds
ENDS[LETTER, [DIGIT, MARK, APOSTROPHE, WHITE]] = True
ENDS[DIGIT, [LETTER, MARK, APOSTROPHE, WHITE]] = True
ENDS[MARK, [LETTER, DIGIT, WHITE]] = True
ENDS[APOSTROPHE, WHITE] = True


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of every byte of UTF-8."""
    kind = KIND[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first, second = data[lead], data[lead + 1]
        sure = lead[LETTER_LEADS[first] & ~((first == 0xC3) & ((second == 0x97) | (second == 0xB7)))]
        kind[sure] = kind[sure + 1] = LETTER
        kind[lead[np.isin(first.astype(np.uint16) << 8 | second, WHITE_STARTS)]] = MAYBE_WHITE
    return kind


def word_ends(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A flag for every byte and the end: whether texts that begin at ``starts``, none empty, are cut before it."""
    kind, cut = kinds(data), np.zeros(len(data) + 1, bool)
    cut[1:-1] = ENDS.ravel()[kind[:-1] * np.uint8(7) + kind[1:]]
    ahead = kind == WHITE  # white space with another character behind it in the same text
    ahead[:-1] &= kind[1:] < WHITE
    ahead[starts - 1] = False  # the last byte of each text; that of the last one by way of -1
    cut[:-1] |= ahead
    cut[1:] |= ahead & (data != 0x20)
    cut[starts] = cut[-1] = True
    return cut


@lru_cache(maxsize=2)
def fine_rule(raw: bytes) -> tuple[bool, tuple[str, ...]]:
    """Whether words of a vocabulary end by the pattern above, and its added tokens, which are found before that."""
    made = byte_bpe(raw)
    split = json.loads(made.pre_tokenizer.__getstate__()) if made.pre_tokenizer else {}
    fine = made.normalizer is None and {k: split.get(k) for k in PATTERN} == PATTERN
    return fine, tuple(t.content for t in made.get_added_tokens_decoder().values())


def pieces(texts: pa.LargeStringArray, raw: bytes) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(the pieces of the texts, none null, one after the other, the number of pieces before each text and in all). Texts
    that hold an added token are cut into runs, as are all when the vocabulary has another pattern."""
    _, offsets, content = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    first, size = int(bounds[0]), int(bounds[-1] - bounds[0])
    if not size:
        return pa.array([], pa.large_string()).dictionary_encode(), np.zeros(len(bounds), np.int64)
    data, bounds = np.frombuffer(content, np.uint8, size, first), bounds - first
    fine, added = fine_rule(raw)
    cut = word_ends(data, bounds[:-1][np.diff(bounds) > 0])
    coarse = np.full(len(texts), not fine)
    for token in added:
        coarse |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(coarse):
        at = bounds[i] + np.cumsum([len(r.encode()) for r in spaced(texts[i].as_py())], dtype=np.int64)
        cut[bounds[i] + 1:bounds[i + 1]] = False
        cut[at] = True
    at = np.flatnonzero(cut)
    found = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data))
    return found.dictionary_encode(), np.searchsorted(at, bounds)


def file_bytes(spark: SparkSession, path: str):
    """The vocabulary file, read where the driver runs and sent to the executors once; 2 MB at most here."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


@lru_cache(maxsize=4)
def byte_bpe(raw: bytes, plain_specials: bool = False):
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(raw.decode("utf-8"))
    made.encode_special_tokens = plain_specials
    return made


@lru_cache(maxsize=2)
def piece_bpe(raw: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=raw)


@lru_cache(maxsize=2)
def bytes_of_ids(raw: bytes) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary; special tokens are their own text."""
    of, made = byte_table(), byte_bpe(raw)
    names = (made.id_to_token(i) or "" for i in range(made.get_vocab_size()))
    return [bytes(of[c] for c in name) if all(c in of for c in name) else name.encode() for name in names]


@lru_cache(maxsize=2)
def sizes_of_ids(raw: bytes) -> np.ndarray:
    return np.array([len(b) for b in bytes_of_ids(raw)], np.int64)


def encode_runs(raw: bytes, runs: list[str], plain_specials: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(runs in the order of their ids, ids one after the other, number of ids of each). Runs that begin with one space
    are encoded many at once, as one text that they make, and cut again by the length of their bytes."""
    made, sizes = byte_bpe(raw, plain_specials), sizes_of_ids(raw)
    joint, single = [], []
    for r in runs:
        (joint if r[0] == " " and len(r) > 1 and not r[-1].isspace() and not r[1].isspace() else single).append(r)
    ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(joint), JOINED):
        part = joint[at:at + JOINED]
        text = "".join(part)
        got = np.array(made.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        ends = np.cumsum([*map(len, part)] if text.isascii() else [len(r.encode()) for r in part])
        ids.append(got)
        counts.append(np.diff(np.searchsorted(np.cumsum(sizes[got]), ends, side="right"), prepend=0))
    for at in range(0, len(single), JOINED):
        for e in made.encode_batch_fast(single[at:at + JOINED], add_special_tokens=False):
            ids.append(np.array(e.ids, np.int64))
            counts.append(np.array([len(e.ids)]))
    return joint + single, np.concatenate(ids), np.concatenate(counts)


def batches_of(texts: list[str]) -> Iterator[slice]:
    """Places of consecutive texts that are encoded together."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text) + 1
        if held >= BATCH:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
