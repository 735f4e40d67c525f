"""Phrase counts that leave a task packed, and the disk that a digest takes."""

import math
import random
from collections import Counter
from datetime import datetime

import pyarrow as pa

from tests.test_rules import AS_OF, reviews
from venuelens.operators import packed, report, themes


def shuffle_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_"))


def some_rows(n, seed=3):
    rnd = random.Random(seed)
    words = ["", "a", "é", "日本語の長い言葉", "customer one", "customer two", *(f"word{i}" for i in range(60))]
    return [(rnd.choice(["A", "Bé", "", None]), rnd.randrange(2), sorted({rnd.choice(words) for _ in range(rnd.randrange(9))})) for _ in range(n)]


def counted(rows):
    pos, neg = Counter(), Counter()
    for key, flag, texts in rows:
        if key is not None:
            (pos if flag else neg).update((key, t) for t in texts)
    return {(*k, pos[k], neg[k]) for k in pos | neg}


def test_packed_counts_are_those_of_plain_python(spark):
    rows = some_rows(400)
    df = spark.createDataFrame(rows, "k string, flag int, texts array<string>").repartition(5)
    for pieces in (1, 7):
        got = packed.telling_texts(df, "k", "texts", "flag", pieces, "t", 10**6).collect()
        assert len(got) == len(counted(rows)) and {tuple(r) for r in got} == counted(rows)
    assert packed.telling_texts(df.limit(0), "k", "texts", "flag", 3, "t", 2).count() == 0


def test_only_rows_that_others_surely_precede_are_left_out(monkeypatch):
    monkeypatch.setattr(packed, "HELD_BYTES", 2_000)
    monkeypatch.setattr(packed, "HELD_ROWS", 50)
    rows = some_rows(900, 4)
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.string(), pa.int32(), pa.list_(pa.string())))], ["k", "flag", "texts"])
    parts = list(packed._packing(1)(batch([r for r in rows[i : i + 30] if r[0] is not None]) for i in range(0, 900, 30)))
    assert len(parts) > 5
    for best in (1, 3, 20):
        got = {tuple(r.values()) for r in packed._adding("k", "t", best)(pa.Table.from_batches(parts)).to_pylist()}
        whole = counted(rows)
        assert got <= whole and (best > 3 or len(got) < len(whole))
        for total, sign in ((7, 1), (7, -1), (3000, 1), (3000, -1)):
            weight = lambda r: round(math.log((r[2] + 1) / (total + 2) / ((r[3] + 1) / 1002)), 6) * sign
            order = lambda r: (r[0], -weight(r), -(r[2] if sign > 0 else r[3]), r[1].encode())
            for key in ("A", "Bé", ""):
                first = lambda found: sorted((r for r in found if r[0] == key and weight(r) > 0), key=order)[:best]
                assert first(got) == first(whole)


def test_digest_takes_little_disk(spark):
    rnd = random.Random(5)
    line = lambda: " ".join(f"{rnd.choice('abcdef')}{rnd.randrange(3000)}" for _ in range(10)) + ". "
    texts = ["".join(line() for _ in range(20)) + "Great soup" for _ in range(1500)]
    df = reviews(spark, *[dict(review_id=str(i), review_text=t, review_rating=1 + i % 5, review_datetime_utc=datetime(2024, 1, 20)) for i, t in enumerate(texts)])
    week = report.current_week(df, AS_OF)
    before, size = shuffle_bytes(spark), sum(map(len, texts))
    assert len(themes.review_digest(week).collect()) == 2
    assert shuffle_bytes(spark) - before < size / 4
    phrases = [(p, 1, sorted({*w, *map(" ".join, zip(w, w[1:]))})) for p, w in (("A", t.split()) for t in texts[:300])]
    parts = list(packed._packing(1)([pa.RecordBatch.from_pylist([dict(k=k, flag=f, texts=t) for k, f, t in phrases])]))
    assert sum(p.nbytes for p in parts) < 8 * len(counted(phrases))
