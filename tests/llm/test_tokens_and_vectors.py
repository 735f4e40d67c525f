"""Whitening, token alignment and token-id shards against brute force, with edge rows."""

import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from venuelens.llm import queries, token_alignment, token_store, tokens, whitening

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string, start string, n_a string, chunk string"
BITS = ["a", " ", "  ", "\n", "\t", "é", "ß", "😀", "▁", "<|endoftext|>", "<s>", "</s>", "<0x41>", "word", "'s", "don't", "12345", "...", " ", "\x1c", "\x85",
        "中文", "👨‍👩‍👧", "x" * 90, "A" * 40, "the", "of the", "\u0000", "ﬁ", "À"]


def raw(path):
    with open(path, "rb") as f:
        return f.read()


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) + rng.choice(["", " "]) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS)


# --- runs ---

def test_runs_have_the_ids_of_the_whole_text():
    raw_a, raw_b = raw(A), raw(B)
    for text in texts(800, 1) + ["", "long words " * 130_000, "A" * 5000]:
        whole = tokens.byte_bpe(raw_a).encode(text, add_special_tokens=False).ids
        assert "".join(tokens.spaced(text)) == text
        packed = next(token_store.encoded([text], raw_a, 2))
        assert np.frombuffer(packed, "<u2").tolist() == whole, repr(text)
        if "▁" in text or "\0" in text:
            continue  # such a text has no tokens in the alignment
        cut = [r for part in tokens.runs(text) for r in part]
        b = [x for r in cut for x in tokens.piece_bpe(raw_b).encode(r)]
        assert b == tokens.piece_bpe(raw_b).encode(text), repr(text)
        a = [x for r in cut for x in tokens.byte_bpe(raw_a, True).encode(" " + r, add_special_tokens=False).ids]
        assert not text or a == tokens.byte_bpe(raw_a, True).encode(" " + text, add_special_tokens=False).ids, repr(text)


def test_pieces_have_the_ids_of_the_whole_text():
    """At every white space, mark and letter of one kind beside those of another, in texts that follow each other."""
    raw_a, rng = raw(A), random.Random(8)
    of = tokens.byte_bpe(raw_a)
    odd = [*"aZ09 \n\t'\".,é×÷ßÿŃЖя҃\r\x0b\x1c\x1f\x00\x7f\x85\xa0\u1680\u180e\u2003\u2028\u3000\u200b中한«”½", "'s", "'ll", "  ", " \n", "\n\n", "<|endoftext|>", "<|", "|>"]
    around = [f"a{c}b{c}1{c}{c}.{c} x {c}\n{c} {c}'s{c}a  {c}  \n{c}\nd\n\n{c}" for c in map(chr, [*range(0x600), *range(0x1600, 0x1900), *range(0x2000, 0x2100),
                                                                                             *range(0x2FF0, 0x3010)])]
    mixed = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 20))) for _ in range(8000)]
    for part in (around, mixed, ["", " ", "", "x", " "], [""], []):
        want = of.encode_batch_fast(part, add_special_tokens=False)
        for text, got, e in zip(part, token_store.encoded(part, raw_a, 2), want, strict=True):
            assert np.frombuffer(got, "<u2").tolist() == e.ids, repr(text)


def test_other_patterns_are_cut_into_runs():
    made = json.loads(raw(A))
    made["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"}, "behavior": "Isolated", "invert": False},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    other = json.dumps(made).encode()
    part = ["one,two 12345.six", "(the of) the-of", ""]
    want = [e.ids for e in tokens.byte_bpe(other).encode_batch_fast(part, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u2").tolist() for b in token_store.encoded(part, other, 2)] == want
    assert want[0] != tokens.byte_bpe(raw(A)).encode(part[0], add_special_tokens=False).ids


def test_a_word_is_encoded_once_beside_any_marks(monkeypatch):
    seen, encode = [], tokens.encode_runs
    monkeypatch.setattr(tokens, "encode_runs", lambda raw, runs, *more: seen.extend(runs) or encode(raw, runs, *more))
    words = [f" {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}xylophone" for i in range(100)]
    part = ["".join(w + m for w in words) for m in (",", ".", "!?", ":", ".\n", ";", " (", "")]
    assert sum(map(len, token_store.encoded(part, raw(A), 2)))
    assert sum("xylophone" in r for r in seen) == len(words)


def test_a_full_table_keeps_what_is_often_met(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 50)
    seen = []
    table = tokens.Table(lambda missing: seen.extend(missing) or [(r, len(r)) for r in missing])
    often, long = [f"often{i}" for i in range(20)], "x" * (tokens.LONGEST_KEPT + 1)
    for turn in range(30):
        wanted = [*often, *(f"once{turn}.{i}" for i in range(20)), long]
        assert table.of(wanted) == [len(r) for r in wanted]
        assert len(table.young) + len(table.old) <= 3 * 50
    assert Counter(seen)[often[0]] == Counter(seen)["once3.0"] == 1 and Counter(seen)[long] == 30


# --- alignment ---

def brute_alignment(rows):
    """From the definition: whole texts, offsets, all pairs of every group."""
    a_of, b_of = tokens.byte_bpe(raw(A), True), tokens.piece_bpe(raw(B))
    table = tokens.byte_table()
    found = []
    for _, text in rows:
        groups = []
        if text:
            a, b = a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)
            of_a = [bytes(table[c] for c in a_of.id_to_token(i)) for i in a]
            names = [b_of.id_to_piece(i) for i in b]
            of_b = [bytes([int(n[3:5], 16)]) if b_of.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(b, names)]
            if b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
                ends = lambda parts: np.cumsum([len(p) for p in parts])
                common = np.intersect1d(ends(of_a), ends(of_b))
                groups = [([], []) for _ in common]
                for side, (ids, parts) in enumerate(((a, of_a), (b, of_b))):
                    for x, g in zip(ids, np.searchsorted(common, ends(parts))):
                        groups[g][side].append(x)
        found.append(groups)
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in found]
    count = Counter(pair for doc in links for pair in doc)
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for (doc_id, _), groups, linked in zip(rows, found, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(linked.values()),
                    sum(n for p, n in linked.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in linked.items()),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def got_alignment(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_alignment_agrees_with_all_pairs(spark, monkeypatch, small):
    rows = [*enumerate(texts(120, 2)), (None, "same text here"), (500, "same text here"), (500, "same text here"), (501, None), (502, ""),
            (503, " "), (504, "bad ▁ mark"), (505, "A" * 3000), (506, "the cat and the dog " * 800)]
    if small:  # many chunks, most containers as bitmaps
        monkeypatch.setattr(token_alignment, "ENTRIES", 500)
        monkeypatch.setattr(token_alignment, "ROWS", 7)
    index = token_alignment.pair_index(docs_of(spark, rows).repartition(3), A, B)
    assert got_alignment(token_alignment.scored(index)) == sorted(brute_alignment(rows), key=str)
    pairs = token_alignment.pair_counts(index)
    assert pairs.agg(F.sum("links")).first()[0] == sum(r[4] for r in brute_alignment(rows))
    assert token_alignment.alignment(docs_of(spark, rows).limit(0), A, B).count() == 0


def test_alignment_of_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got_alignment(queries.op12_token_alignment(spark, SF)) == sorted(brute_alignment(rows), key=str)


def test_postings_give_back_what_went_in():
    rng = np.random.default_rng(4)
    pairs = np.concatenate([np.full(60_000, 7 << 32 | 9), np.full(3000, 8), rng.integers(0, 50, 5000) << 32])
    docs = np.concatenate([rng.permutation(65_536)[:60_000], rng.permutation(65_536)[:3000], rng.integers(0, 65_536, 5000)])
    links = rng.integers(1, 5, len(pairs)) ** 6
    want = Counter()
    for p, d, n in zip(pairs.tolist(), docs.tolist(), links.tolist()):
        want[p, d] += n
    got, dense = {}, 0
    for batch in token_alignment.index_rows(pairs, docs, links, 3):
        row, doc, n = token_alignment.multiplicities(batch.column(5), batch.column(6))
        key = batch.column(1).to_numpy().astype(np.int64) << 32 | batch.column(2).to_numpy()
        got.update({(int(key[r]), int(d)): int(x) for r, d, x in zip(row, doc, n)})
        assert batch.column(3).to_pylist() == np.bincount(row, minlength=batch.num_rows).tolist()
        assert batch.column(4).to_pylist() == np.bincount(row, n, batch.num_rows).astype(int).tolist()
        dense += sum(len(x) == 8192 for x in batch.column(5).to_pylist())
    assert got == dict(want) and dense == 1
    assert list(token_alignment.index_rows(*[np.zeros(0, np.int64)] * 3, 0)) == []


# --- ids in shards ---

@pytest.mark.parametrize("seed", range(12))
def test_boundaries_round_trip(seed):
    rng = random.Random(seed)
    top = rng.choice([0, 1, 5, 1000, 1 << 20, 1 << 40, (1 << 64) - 1])
    values = sorted(rng.randint(0, top) for _ in range(rng.choice([0, 1, 2, 511, 512, 513, 3000])))
    code = token_store.EliasFano.read(memoryview(token_store.EliasFano.of(np.array(values, np.uint64)).to_bytes()))
    assert code.all().tolist() == values
    places = [*range(len(values))][:: max(1, len(values) // 50)]
    assert [code.select(i) for i in places] == [values[i] for i in places]
    with pytest.raises(IndexError):
        code.select(len(values))


def test_boundaries_are_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 1200, 100_000).astype(np.uint64))
    assert len(token_store.EliasFano.of(ends).to_bytes()) < 100_000 * 12 / 8 + 4096


@pytest.mark.parametrize("shard_ids", [token_store.SHARD_IDS, 40])
def test_shards_hold_the_ids(spark, tmp_path, shard_ids):
    rows = [(i * 7 - 300, t) for i, t in enumerate(texts(150, 3))] + [
        (None, "no id"), (None, None), (4, "b"), (4, "a"), (4, "a"), (5, None), (6, ""), (-1 << 63, "least"), ((1 << 63) - 1, "most"), (8, "\n" * 50),
        (9, "many words " * 3000)]
    random.Random(5).shuffle(rows)
    path = str(tmp_path / "ids")
    token_store.write_ids(docs_of(spark, rows).repartition(5), path, A, shard_ids=shard_ids)
    of = tokens.byte_bpe(raw(A))
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want = sorted([(i is not None, i or 0, of.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows], key=lambda r: r[:2])
    got = sorted(token_store.read_ids(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [w[:2] for w in want]
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == sorted((str(w[1]) if w[0] else "None", crc(w[2])) for w in want)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and crc(r.ids) == r.ids_crc32 and r.ids[-1] == 0
        at += r.n_tokens
    files = [r.content for r in token_store._files(spark, path).select("content").collect()]
    assert (len(files) > 20) == (shard_ids == 40)
    shard = token_store.Shard.read(bytes(max(files, key=len)))
    ends = shard.ends.all().tolist()
    assert [shard.bounds(i)[1] for i in range(len(ends))] == ends and shard.bounds(0)[0] == 0 and ends[-1] == shard.n_ids


def test_shards_of_an_empty_table(spark, tmp_path):
    token_store.write_ids(docs_of(spark, [(1, "x")]).limit(0), str(tmp_path / "none"), A)
    assert token_store.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_ids_of_the_whole_table(spark):
    of, at = tokens.byte_bpe(raw(A)), 0
    want = []
    for doc_id, text in sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()):
        ids = of.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op13_token_ids(spark, SF).collect()) == want


# --- whitening ---

def check_pairs(v, k):
    values, vectors = whitening.leading_eigenvectors(v, k)
    scale = max(np.abs(v).max(), 1e-300) * len(v)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:k], rtol=0, atol=1e-14 * scale)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.abs(v @ vectors - vectors * values).max() < 1e-13 * scale


@pytest.mark.parametrize("n", [1, 2, 3, 5, 40, 64, 130])
def test_eigenvectors_agree_with_the_library(n):
    rng = np.random.default_rng(n)
    m = rng.normal(size=(n, n))
    for v in (m @ m.T, np.eye(n) * 3, np.zeros((n, n)), np.outer(m[0], m[0]), np.diag(np.repeat(np.arange(n // 2 + 1.0), 2)[:n]), m + m.T,
              np.kron(np.eye(n // 2 + 1), [[2, 1], [1, 2]])[:n, :n], (m @ m.T) * 1e-12, np.diag([1e8] + [1.0] * (n - 1)) + 1e-9 * (m + m.T)):
        check_pairs(v, min(n, 32))


def brute_whitening(vectors, k=32):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    centred = np.array([[float(a) for a in (n * row - s)] for row in x]) / n
    v = centred.T @ centred / n
    values, vecs = np.linalg.eigh(v)
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    return [sum(int(a) ** 2 for a in n * row - s) for row in x], centred @ vecs / np.sqrt(values), values / np.trace(v)


def test_whitening_of_the_whole_table(spark):
    source = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    good = {i: v for i, v in source.items() if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    ids = sorted(good)
    deviation, want, explained = brute_whitening([good[i] for i in ids])
    got = queries.op11_whitening(spark, SF).collect()
    assert len(got) == 32 * len(ids)
    made, place = np.zeros((len(ids), 32)), {v: i for i, v in enumerate(ids)}
    for r in got:
        made[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == len(ids) and r.deviation == deviation[place[r.vec_id]] and 0 <= r.identity_error < 1e-9
        assert abs(r.explained - explained[r.component - 1]) < 1e-10
    made *= np.sign((made * want).sum(axis=0))
    assert np.abs(made - want).max() < 1e-8


def test_whitening_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(size=5) * [9, 4, 2, 1, 0]], "x") for i in range(60)]
    odd = [(100, None, "x"), (101, [], "x"), (102, [1.0, None, 0.0, 0.0, 0.0], "x"), (103, [float("nan")] * 5, "x"), (104, [float("inf")] * 5, "x"),
           (105, [1.0, 2.0], "x"), (106, [1e30] * 5, "x")]
    twice = [rows[3], (None, rows[4][1], "x")]
    schema = "vec_id long, embedding array<double>, component string"
    df = spark.createDataFrame(rows + odd + twice, schema).repartition(4)
    got = whitening.whitened(df).collect()
    deviation, want, _ = brute_whitening([r[1] for r in rows + twice], 4)
    assert len(got) == 62 * 4  # the fifth dimension never varies
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation)
    assert sum(r.vec_id == 3 for r in got) == 8 and sum(r.vec_id is None for r in got) == 4 and max(r.identity_error for r in got) < 1e-9
    assert np.allclose(sorted(abs(r.whitened) for r in got if r.component == 1), sorted(np.abs(want[:, 0])))
    assert whitening.whitened(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], "x") for i in range(5)], schema)
    assert whitening.whitened(same).count() == 0 and whitening.whitened(same.limit(1)).count() == 0
    far = spark.createDataFrame([(i, [float(i) * 1e12, 1.0 * (i % 2)], "x") for i in range(4)], schema)
    big = {r.vec_id: r.deviation for r in whitening.whitened(far).collect()}
    assert big[0] is None and len(big) == 4
    large = spark.createDataFrame([(i, [float(i) * 1e12, 0.0, 0.0], "x") for i in range(2)] * 3, schema)
    n, total = whitening.sums(whitening.valid(large), 3)
    assert n == 6 and total[0] == 3 * (64 * 10 ** 12) + 6 * 1_000_000
