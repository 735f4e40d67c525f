"""Alignment of two tokenizers over a corpus: an inverted index of linked id pairs, with document bitmaps.

Postings of a pair are compressed bitmaps of document numbers, in containers of one chunk (at most 65,536 documents of
one task): a sorted array of 16-bit numbers, or 8,192 bytes of bits where that is smaller. Beside the bitmap of the
documents that hold the pair lie multiplicity planes: plane k has the documents whose number of links has bit k set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuelens.llm import tokens
from venuelens.llm.common import stored

DOCS = 1 << 16           # documents of a chunk
ENTRIES = 1 << 21        # (pair, document) entries that a chunk takes before it ends
DENSE = DOCS // 16       # documents from which on a container is a bitmap
PARTS = 256              # tasks of the first pass whose chunks form one range of the index
ROWS = 20_000            # index rows handed on at once
INDEX = ("chunk long, no int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
         "a int, b int, documents long, links long, docs binary, planes array<binary>")
_DOC = ("chunk", "no", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
_PAIR = ("chunk", "a", "b", "documents", "links", "docs", "planes")


# --- containers ---

def containers(owner: np.ndarray, docs: np.ndarray, n: int) -> pa.BinaryArray:
    """A container for each of ``n`` owners, from entries sorted by owner and document."""
    counts = np.bincount(owner, minlength=n)
    if counts.max(initial=0) < DENSE:
        offsets = np.concatenate([[0], np.cumsum(2 * counts)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(docs.astype("<u2").tobytes())])
    out, at = [], 0
    for count in counts:
        mine = docs[at:at + count]
        at += count
        if count < DENSE:
            out.append(mine.astype("<u2").tobytes())
        else:
            bits = np.zeros(DOCS, np.uint8)
            bits[mine] = 1
            out.append(np.packbits(bits, bitorder="little").tobytes())
    return pa.array(out, pa.binary())


def opened(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, document) of every entry of the containers, sorted."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    raw = column.to_pylist()
    sparse = np.flatnonzero(size < 2 * DENSE)
    owner = [np.repeat(sparse, size[sparse] // 2)]
    docs = [np.frombuffer(b"".join([raw[i] for i in sparse]), "<u2").astype(np.int64)]
    for i in np.flatnonzero(size >= 2 * DENSE):
        docs.append(np.flatnonzero(np.unpackbits(np.frombuffer(raw[i], np.uint8), bitorder="little")))
        owner.append(np.full(len(docs[-1]), i))
    owner, docs = np.concatenate(owner), np.concatenate(docs)
    if len(sparse) < len(column):
        order = np.argsort(owner * DOCS + docs, kind="stable")
        owner, docs = owner[order], docs[order]
    return owner, docs


def multiplicities(docs: pa.BinaryArray, planes: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, document, links) of every entry: the planes' bits put together; a row without planes has one link each."""
    row, doc = opened(docs)
    depth = pc.list_value_length(planes).to_numpy(zero_copy_only=False)
    links = np.where(depth[row] == 0, 1, 0).astype(np.int64)
    flat = planes.flatten()
    if len(flat):
        plane_row = np.repeat(np.arange(len(depth)), depth)
        plane = np.arange(len(flat)) - np.repeat(np.cumsum(depth) - depth, depth)
        at, where = opened(flat)
        place = np.searchsorted(row * DOCS + doc, plane_row[at] * DOCS + where)
        np.add.at(links, place, np.int64(1) << plane[at])
    return row, doc, links


def index_rows(pairs: np.ndarray, docs: np.ndarray, links: np.ndarray, chunk: int) -> Iterator[pa.RecordBatch]:
    """Index rows of entries (pair, document, links) in any order; entries of one pair and document are one link
    count: their bitmaps are OR-merged."""
    order = np.lexsort((docs, pairs))
    pairs, docs, links = pairs[order], docs[order], links[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(pairs) != 0) | (np.diff(docs) != 0)])[:len(pairs)])
    links = np.add.reduceat(links, first) if len(first) else links
    pairs, docs = pairs[first], docs[first]
    start = np.flatnonzero(np.concatenate([[True], np.diff(pairs) != 0])[:len(pairs)])
    for low in range(0, len(start), ROWS):
        starts = start[low:low + ROWS]
        end = start[low + ROWS] if low + ROWS < len(start) else len(pairs)
        n = len(starts)
        d, m = docs[starts[0]:end], links[starts[0]:end]
        counts = np.diff(np.append(starts, end))
        owner = np.repeat(np.arange(n), counts)
        most = np.maximum.reduceat(m, starts - starts[0])
        depth = np.where(most > 1, np.ceil(np.log2(most + 1.0)).astype(np.int64), 0)
        base = np.cumsum(depth) - depth
        entries = [np.flatnonzero((m >> k) & 1 & (depth[owner] > 0)) for k in range(int(depth.max(initial=0)))]
        at = np.concatenate([base[owner[e]] + k for k, e in enumerate(entries)]) if entries else np.zeros(0, np.int64)
        of = np.concatenate([d[e] for e in entries]) if entries else np.zeros(0, np.int64)
        sort = np.argsort(at * DOCS + of)
        planes = pa.ListArray.from_arrays(np.append(base, depth.sum()).astype(np.int32), containers(at[sort], of[sort], int(depth.sum())))
        key = pairs[starts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, chunk, np.int64)), pa.array((key >> 32).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)),
             pa.array(counts.astype(np.int64)), pa.array(np.add.reduceat(m, starts - starts[0])), containers(owner, d, n), planes],
            names=list(_PAIR))


# --- runs of a text ---

@lru_cache(maxsize=2)
def piece_bytes(raw: bytes) -> list[bytes]:
    made = tokens.piece_bpe(raw)
    return [bytes([int(made.id_to_piece(i)[3:5], 16)]) if made.is_byte(i) else made.id_to_piece(i).replace("▁", " ").encode()
            for i in range(made.get_piece_size())]


_NUMBERS = [str(i).encode() for i in range(1 << 16)]
_DIGITS = np.frombuffer(b"".join(n.ljust(6) for n in _NUMBERS), np.uint8).reshape(-1, 6)
_WIDTH = np.array([len(n) for n in _NUMBERS], np.int64)
BIG = 256  # links of a group from which on its distinct pairs are counted instead of written out


def group_texts(ids: np.ndarray, marks: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids in decimal, each with its mark behind it, and the number of bytes of each."""
    chars, width = _DIGITS[ids], _WIDTH[ids]
    chars[np.arange(len(ids)), width] = marks
    return chars[np.arange(6) <= width[:, None]].tobytes(), width + 1


@dataclass
class Runs:
    """What the runs of some texts come to; run i has stats[i] (A ids, B ids, groups, links), text[i] (its groups,
    each closed by a semicolon), and the pairs and links from start[i] on; not ok where bytes do not agree."""

    number: dict[str, int]
    ok: np.ndarray
    stats: np.ndarray
    text: list[bytes]
    start: np.ndarray
    pairs: np.ndarray
    links: np.ndarray


def _agree(ids: np.ndarray, counts: np.ndarray, table: list[bytes], want: list[bytes]) -> np.ndarray:
    """Whether the ids of each run have its bytes."""
    if b"".join(map(table.__getitem__, ids.tolist())) == b"".join(want):
        sizes = np.array([len(b) for b in table], np.int64)[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        if np.array_equal(np.diff(ends), [len(w) for w in want]):
            return np.ones(len(want), bool)
    ends = np.cumsum(counts).tolist()
    return np.array([b"".join([table[x] for x in ids[a:b]]) == w for a, b, w in zip([0, *ends], ends, want)], bool)


def aligned_runs(runs: list[str], raw_a: bytes, raw_b: bytes) -> Runs:
    """All runs side by side: their byte offsets run on, and as both tokenizers end at every run's end, no group
    crosses from one run to the next."""
    spaced, a, count_a = tokens.encode_runs(raw_a, [" " + r for r in runs], True)
    runs = [r[1:] for r in spaced]
    found = tokens.piece_bpe(raw_b).encode(runs, num_threads=1)
    b, count_b = np.fromiter(chain.from_iterable(found), np.int64), np.array([len(x) for x in found], np.int64)
    want, table_b = [r.encode() for r in spaced], piece_bytes(raw_b)
    ok = _agree(a, count_a, tokens.bytes_of_ids(raw_a), want) & _agree(b, count_b, table_b, want)
    a, b = a[np.repeat(ok, count_a)], b[np.repeat(ok, count_b)]
    count_a, count_b = np.where(ok, count_a, 0), np.where(ok, count_b, 0)

    ends_a = np.cumsum(tokens.sizes_of_ids(raw_a)[a])
    ends_b = np.cumsum(np.array([len(x) for x in table_b], np.int64)[b])
    common = ends_a[np.isin(ends_a, ends_b, assume_unique=True)]
    group_a, group_b, n = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b), len(common)
    in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    from_a, from_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    run_of = np.repeat(np.arange(len(runs)), count_a)[from_a]
    product = in_a * in_b

    # the ids of a group: those of A, then those of B
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    last = lambda group: np.append(np.diff(group) != 0, [True] * bool(len(group)))
    marks = np.concatenate([np.where(last(group_a), ord("|"), ord(",")), np.where(last(group_b), ord(";"), ord(","))])
    text, width = group_texts(np.concatenate([a, b])[order], marks[order])
    ends = np.concatenate([[0], np.cumsum(width)])[np.cumsum(count_a + count_b)].tolist()

    small = product <= BIG
    times = np.where(small, in_b, 0)[group_a]
    inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    linked_b = b[np.repeat(from_b[group_a], times) + inside]
    owner, pairs = [np.repeat(run_of[group_a], times)], [np.repeat(a, times) << 32 | linked_b]
    links = [np.ones(len(linked_b), np.int64)]
    for g in np.flatnonzero(~small):
        of_a, n_a = np.unique(a[from_a[g]:from_a[g] + in_a[g]], return_counts=True)
        of_b, n_b = np.unique(b[from_b[g]:from_b[g] + in_b[g]], return_counts=True)
        pairs.append(np.repeat(of_a, len(of_b)) << 32 | np.tile(of_b, len(of_a)))
        links.append(np.outer(n_a, n_b).ravel())
        owner.append(np.full(len(pairs[-1]), run_of[g]))
    owner, pairs, links = (np.concatenate(x) for x in (owner, pairs, links))
    sort = np.argsort(owner, kind="stable")
    stats = np.column_stack([count_a, count_b, np.bincount(run_of, minlength=len(runs)),
                             np.bincount(run_of, product, minlength=len(runs)).astype(np.int64)])
    start = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(runs)))])
    return Runs({r: i for i, r in enumerate(runs)}, ok, stats, [text[x:y] for x, y in zip([0, *ends], ends)], start, pairs[sort], links[sort])


class RunStore:
    """Aligned runs of a worker process, in parts as they were met, up to a bound."""

    def __init__(self, raw_a: bytes, raw_b: bytes):
        self.raw, self.parts, self.where = (raw_a, raw_b), [], {}

    def of(self, wanted: list[str]) -> Runs:
        """Exactly the distinct wanted runs, as one part."""
        wanted = list(dict.fromkeys(wanted))
        if len(self.where) > tokens.KEPT:
            self.parts, self.where = [], {}
        missing = [r for r in wanted if r not in self.where]
        if missing:
            short = [r for r in missing if len(r) <= tokens.LONGEST_KEPT]
            self.parts.append(aligned_runs(short, *self.raw))
            part = len(self.parts) - 1
            self.where.update((r, (part, i)) for r, i in self.parts[part].number.items())
        parts = [*self.parts]
        if len(missing) and len(short) < len(missing):
            parts.append(aligned_runs([r for r in missing if len(r) > tokens.LONGEST_KEPT], *self.raw))
        last = parts[-1].number if parts else {}
        places = [self.where.get(r) or (len(parts) - 1, last[r]) for r in wanted]
        part, at = (np.array(x, np.int64) for x in zip(*places)) if places else (np.zeros(0, np.int64),) * 2
        order = np.argsort(part, kind="stable")
        got: list[list] = [[], [], [], [], [], []]
        for p in np.unique(part):
            runs, mine = parts[p], at[part == p]
            size = runs.start[mine + 1] - runs.start[mine]
            take = np.repeat(runs.start[mine], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            for to, x in zip(got, (runs.ok[mine], runs.stats[mine], [runs.text[i] for i in mine], size, runs.pairs[take], runs.links[take])):
                to.append(x)
        if not places:
            return Runs({}, np.zeros(0, bool), np.zeros((0, 4), np.int64), [], np.zeros(1, np.int64), *[np.zeros(0, np.int64)] * 2)
        ok, stats, _, size, pairs, links = (np.concatenate(x) if i != 2 else None for i, x in enumerate(got))
        return Runs({wanted[w]: i for i, w in enumerate(order)}, ok, stats, list(chain.from_iterable(got[2])),
                    np.concatenate([[0], np.cumsum(size)]), pairs, links)


@lru_cache(maxsize=2)
def shared_store(raw_a: bytes, raw_b: bytes) -> RunStore:
    """The store of this worker process."""
    return RunStore(raw_a, raw_b)


def aligned(texts: list[str], store: RunStore) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]]:
    """Of texts encoded together: a row (n_a, n_b, n_groups, n_links, groups' hash) for each, and (place of the text, pair,
    links) of its pairs; a pair can come several times."""
    for part in tokens.batches_of(texts):
        words = [list(chain.from_iterable(tokens.runs(t))) for t in texts[part]]
        runs = store.of(list(chain.from_iterable(words)))
        rows, place, run_no = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, mine in enumerate(words):
            numbers = [runs.number[w] for w in mine]
            at = np.array(numbers, np.int64)
            if not numbers or not runs.ok[at].all():
                rows.append((0, 0, 0, 0, ""))
                continue
            text = b"".join([runs.text[j] for j in numbers])[:-1]
            rows.append((*runs.stats[at].sum(axis=0).tolist(), hashlib.sha256(text).hexdigest()))
            place.append(np.full(len(at), i))
            run_no.append(at)
        key, times = np.unique(np.concatenate(place) << 32 | np.concatenate(run_no), return_counts=True)
        run_no = key & 0xFFFFFFFF
        size = runs.start[run_no + 1] - runs.start[run_no]
        at = np.repeat(runs.start[run_no], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        yield rows, np.repeat(key >> 32, size), runs.pairs[at], runs.links[at] * np.repeat(times, size)


# --- Spark ---

def pair_index(docs: DataFrame, vocabulary_a: str, vocabulary_b: str) -> DataFrame:
    """Written once: a row per row of ``docs`` (doc_id, text), named by chunk and number, and a row per pair and chunk
    with its postings. Texts that are null, empty, or that one of the tokenizers does not give back have no tokens."""
    spark = docs.sparkSession
    vocab_a, vocab_b = tokens.file_bytes(spark, vocabulary_a), tokens.file_bytes(spark, vocabulary_b)
    schema = pa.schema([("chunk", pa.int64()), ("no", pa.int32()), *[(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")],
                        ("groups_sha256", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("documents", pa.int64()),
                        ("links", pa.int64()), ("docs", pa.binary()), ("planes", pa.list_(pa.binary()))])

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        have = set(batch.schema.names)
        return pa.RecordBatch.from_arrays([batch.column(f.name) if f.name in have else pa.nulls(batch.num_rows, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = shared_store(vocab_a.value, vocab_b.value)
        chunk, number, held, entries = TaskContext.get().partitionId() << 24, 0, [], 0
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            done = 0
            for rows, place, pairs, links in aligned(texts, store):
                at = 0
                while at < len(rows):  # a chunk may end within a batch
                    take = min(len(rows) - at, DOCS - number)
                    inside = (place >= at) & (place < at + take)
                    columns = list(zip(*rows[at:at + take]))
                    yield whole(pa.RecordBatch.from_arrays(
                        [pa.array([chunk] * take, pa.int64()), pa.array(range(number, number + take), pa.int32()), ids.slice(done, take),
                         *[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string())], names=list(_DOC)))
                    held.append((pairs[inside], place[inside] - at + number, links[inside]))
                    entries, number, at, done = entries + len(held[-1][0]), number + take, at + take, done + take
                    if number == DOCS or entries >= ENTRIES:
                        yield from map(whole, index_rows(*(np.concatenate(x) for x in zip(*held)), chunk))
                        chunk, number, held, entries = chunk + 1, 0, [], 0
        if held:
            yield from map(whole, index_rows(*(np.concatenate(x) for x in zip(*held)), chunk))

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                  .mapInArrow(run, INDEX), "pair-index")


def _postings(index: DataFrame) -> DataFrame:
    return index.filter("a is not null").select(*_PAIR, F.shiftright("chunk", 24 + PARTS.bit_length() - 1).alias("range"))


def _range_counts(index: DataFrame) -> DataFrame:
    return _postings(index).groupBy("a", "b", "range").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links"))


def _totals(per_range: DataFrame) -> DataFrame:
    return per_range.groupBy("a", "b").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links"))


def pair_counts(index: DataFrame) -> DataFrame:
    """a, b, documents, links of every linked pair, corpus-wide: the containers' population counts added up. Chunks are
    disjoint ranges of documents, so adding counts is counting the OR of their bitmaps."""
    return _totals(_range_counts(index))


def scored(index: DataFrame) -> DataFrame:
    """A row per document of the index: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Counts go from pairs to ranges of chunks to postings, so a pair that every document holds is no heavy group: it has
    one row per chunk, and at most those of one range meet in a join. The postings then give their scores back to the
    documents of their chunk."""
    per_range = stored(_range_counts(index), "pair-counts")
    totals = _totals(per_range)
    most = totals.groupBy("a").agg(F.max("documents").alias("most"))
    judged = totals.join(most, "a").select("a", "b", F.col("documents").alias("count"), (F.col("documents") == F.col("most")).alias("best"))
    counted = per_range.select("a", "b", "range").join(judged, ["a", "b"])
    postings = _postings(index).join(counted, ["a", "b", "range"]).select("chunk", "docs", "planes", "count", "best")
    both = index.filter("a is null").select(*_DOC).unionByName(postings, allowMissingColumns=True).repartition("chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            is_doc = pc.is_valid(batch.column(1))
            rows.append(batch.filter(is_doc).select(range(len(_DOC))))
            mine = batch.filter(pc.invert(is_doc))
            if not mine.num_rows:
                continue
            row, doc, links = multiplicities(mine.column(8), mine.column(9))
            chunk, count, best = (mine.column(i).to_numpy(zero_copy_only=False) for i in (0, 10, 11))
            for c in np.unique(chunk):
                here = chunk[row] == c
                to = sums.setdefault(int(c), np.zeros((2, DOCS), np.int64))
                np.add.at(to[0], doc[here], links[here] * best[row[here]].astype(np.int64))
                np.add.at(to[1], doc[here], links[here] * count[row[here]])
        for batch in rows:
            chunk, no = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            out = np.zeros((2, batch.num_rows), np.int64)
            for c in np.unique(chunk):
                if int(c) in sums:
                    out[:, chunk == c] = sums[int(c)][:, no[chunk == c]]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:7], pa.array(out[0]), pa.array(out[1]), batch.column(7)],
                                             names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return both.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def alignment(docs: DataFrame, vocabulary_a: str, vocabulary_b: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Space and text by the byte-level vocabulary A, the text by the piece vocabulary B; byte offsets at which tokens of
    both end cut them into groups, and all A-B pairs of a group are links. A pair's count is the number of documents
    that hold it; n_best are the links whose count is the highest of their A id. Null and empty texts, and those whose
    tokens are not their bytes, have zeros and no hash. Null and repeated ids are documents of their own. Whole texts
    are encoded; other columns are not read; an empty table gives no rows."""
    return scored(pair_index(docs, vocabulary_a, vocabulary_b))
