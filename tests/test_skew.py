"""The building blocks against plain Python, with one key holding most of the rows."""

import math
import random
import re
import tracemalloc
from collections import Counter
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from venuelens.operators import lookup, report, retrieval
from venuelens.operators.chat import chat_history, chat_routing
from venuelens.operators.skew import first_per_key, numbered, top_k, with_carry


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_numbered(spark, keys):
    rows = [("hot" if i % 3 else f"k{i % 7}", i * 37 % 1009) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(7)
    got = {(r.k, r.v): r.row_no for r in numbered(df, ["v", "k"] if not keys else ["v"], keys).collect()}
    assert len(got) == 1000
    seen = {}
    for k, v in sorted(rows, key=lambda r: (r[0], r[1]) if keys else (r[1], r[0])):
        group = k if keys else None
        seen[group] = seen.get(group, 0) + 1
        assert got[(k, v)] == seen[group]


def test_numbered_null_key_and_empty(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, v int")
    assert sorted((r.k or "", r.v, r.row_no) for r in numbered(df, ["v"], ["k"]).collect()) == [
        ("", 1, 1), ("", 2, 2), ("a", 1, 1)]
    assert numbered(df.filter("v > 5"), ["v"]).count() == 0


def test_top_k_and_first_per_key(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), (None, 3), (None, 4)], "k string, v int")
    assert sorted(r.v for r in top_k(df, ["k"], [F.col("v").desc()], 2).filter("k = 'a'").collect()) == [48, 49]
    got = sorted((r.k, r.v) for r in first_per_key(df.filter("k is not null"), "k", "v").collect())
    assert got == [("a", 0), ("b", 1)]


@pytest.mark.parametrize("relevant", [False, True])
def test_with_carry_equals_whole_window(spark, relevant):
    random.seed(3)
    rows = [("hot", t, random.random() < 0.2) for t in random.sample(range(400), 200)]
    rows += [("cold", t, True) for t in range(3)] + [("gap", 0, True), ("gap", 395, False), ("gap", 399, False)]
    df = spark.createDataFrame(rows, "u string, t long, good boolean")
    cond = F.col("good") if relevant else F.lit(True)
    look = lambda *p: F.last(F.when(cond, F.col("t")), ignorenulls=True).over(
        Window.partitionBy(*p).orderBy("t").rowsBetween(Window.unboundedPreceding, -1))
    want = {(r.u, r.t): r.p for r in df.withColumn("p", look("u")).collect()}
    cut = with_carry(df, "u", "t", n=1, block=10, relevant=F.col("good") if relevant else None)
    got = {(r.u, r.t): r.p for r in cut.withColumn("p", look("u", "_block")).filter("not _carried").collect()}
    assert got == want


def test_history_and_routing_do_not_depend_on_blocks(spark):
    random.seed(5)
    texts = ["👎", "hi", "thanks!", "👍", "what sold best?", "sales"]
    rows = [("hot", t, random.choice(["user", "assistant", "system"]), random.choice(texts)) for t in range(300)]
    rows += [("b", t, "user", random.choice(texts)) for t in range(20)]
    df = spark.createDataFrame(rows, "user string, turn long, role string, text string")
    as_set = lambda d: {tuple(r) for r in d.collect()}
    assert as_set(chat_history(df, block=7)) == as_set(chat_history(df))
    assert as_set(chat_routing(df, block=7)) == as_set(chat_routing(df))


def _grams(s):
    p = "  " + s.lower() + " "
    return {p[i:i + 3] for i in range(len(p) - 2)}


@pytest.mark.parametrize("hot_values", [1000, 4, 1])
def test_value_lookup_is_exact(spark, hot_values):
    random.seed(9)
    words = ["".join(random.choice("abcd") for _ in range(random.randint(2, 7))) for _ in range(120)] + ["zzz", "q"]
    vocab = [(random.choice(["x", "y"]), w) for w in words] + [("y", "")]
    terms = words[:30] + ["zz", "abx", "", "nothing"]
    v = spark.createDataFrame(sorted(set(vocab)), "kind string, value string")
    t = spark.createDataFrame([(w,) for w in terms], "term string")
    got, joined = {}, {}
    for to, find in ((got, lookup.value_lookup), (joined, lookup.value_lookup_join)):
        for r in find(t, v, k=5, hot_values=hot_values).collect():
            to.setdefault(r.term, []).append((r["rank"], r.value, r.kind))
    assert {term: sorted(r) for term, r in joined.items()} == {term: sorted(r) for term, r in got.items()}
    for term in set(terms):
        scored = []
        for kind, value in set(vocab):
            a, b = _grams(term), _grams(value)
            if a & b:
                scored.append((-len(a & b) / len(a | b), _edit(term, value), value, kind))
        want = [(i + 1, s[2], s[3]) for i, s in enumerate(sorted(scored)[:5])]
        assert sorted(got.get(term, [])) == want, term


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_blocked_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    c = rng.normal(size=(300, 8)).astype("float32")
    c[50:150] = c[50]  # a hundred copies tie on the score
    q = np.vstack([rng.normal(size=(30, 8)), c[50:51] + 0.01]).astype("float32")
    cell_c = [1 if i % 3 else i % 5 for i in range(300)]
    cell_q = [i % 2 for i in range(31)]
    corpus = spark.createDataFrame([(i, c[i].tolist(), cell_c[i]) for i in range(300)], "id long, vec array<float>, cell int")
    queries = spark.createDataFrame([(i, q[i].tolist(), cell_q[i]) for i in range(31)], "query_id long, qvec array<float>, cell int")
    found = retrieval.blocked_top_k(queries, corpus, ["cell"], 4, block_rows=40, block_queries=5).collect()
    unit = lambda m: (m.astype("float64").T / np.linalg.norm(m.astype("float64"), axis=1)).T
    scores = np.round(unit(q) @ unit(c).T, 9)
    for i in range(31):
        pool = [j for j in range(300) if cell_c[j] == cell_q[i]]
        want = sorted(pool, key=lambda j: (-scores[i, j], j))[:4]
        assert [r.id for r in sorted((r for r in found if r.query_id == i), key=lambda r: r["rank"])] == want


def test_regex_names_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(report, "PATTERN_BLOCK", 2)
    names = ["A", "A Plus", "Cafe Andheri", "Cafe (Andheri)", "b.c", "bxc", None]
    wanted = ["A", "Cafe (Andheri)", "b.c", "^a", "s$", "PLUS", "x"]
    n = spark.createDataFrame([(x,) for x in names], "place_name string")
    p = spark.createDataFrame([(x,) for x in wanted], "place_name string")
    got = {(r.pattern, r.place_name) for r in report.match_names(n, p).collect()}
    import re
    assert got == {(w, x) for w in wanted for x in names if x and re.search(w, x, re.IGNORECASE)}


SMALL_TALK = {"hi": "greeting", "thanks!": "thanks"}


def _plain_chat(rows, n=7):
    """(intent per user message, (messages, history) per kept message) of one user, message by message."""
    intents, histories, down, asked, lines = {}, {}, False, False, []
    for _, turn, role, text in sorted(rows, key=lambda r: (r[1], r[2] == "assistant")):
        if role == "user":
            intent = SMALL_TALK.get(text) or ("feedback_down" if text == "👎" else "feedback_detail" if down else
                                              "feedback_up" if text == "👍" else "question")
            intents[turn, role] = intent
            down = down if text in SMALL_TALK else text == "👎"
            asked = intent == "question"
        if role in ("user", "assistant") and asked:
            lines = [*lines, ("User: " if role == "user" else "AI: ") + text][-n:]
            histories[turn, role] = (len(lines), "\n".join(lines))
    return intents, histories


@pytest.mark.parametrize("block, n", [(1, 7), (2, 3), (5, 7), (5, 1), (50, 7), (10_000, 7)])
def test_chat_state_agrees_with_reading_message_by_message(spark, block, n):
    random.seed(block)
    rows = []
    for user in range(12):
        share = random.random()  # some users ask nothing for many blocks
        texts = ["hi", "thanks!", "👎", "👍"] + (["q1", "q2 "] if user % 3 else ["hi"] * 30 + ["q3"])
        rows += [(f"u{user}", t, random.choice(["user", "assistant", "assistant", "system"]), random.choice(texts).strip())
                 for t in range(120) if random.random() < share]
    df = spark.createDataFrame(rows, "user string, turn long, role string, text string").repartition(3)
    intents, histories = {}, {}
    for user in {r[0] for r in rows}:
        i, h = _plain_chat([r for r in rows if r[0] == user], n)
        intents.update({(user, *k): v for k, v in i.items()})
        histories.update({(user, *k): v for k, v in h.items()})
    assert {(r.user, r.turn, "user"): r.intent for r in chat_routing(df, block=block).collect()} == intents
    got = chat_history(df, n, block).collect()
    assert sorted((r.user, r.turn, r.messages, r.history) for r in got) == sorted((k[0], k[1], *v) for k, v in histories.items())


def test_chat_history_reads_its_table_twice_at_most(spark, tmp_path):
    spark.createDataFrame([("u", 1, "user", "q")], "user string, turn long, role string, text string").write.parquet(str(tmp_path / "m"))
    plan = chat_history(spark.read.parquet(str(tmp_path / "m")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2


def test_inverted_file_is_exact_and_skips_far_cells(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 12))
    rows = [(i, (centres[i % 40] + 0.05 * rng.normal(size=12)).astype("float32").tolist(), 1 + i % 3, f"2024-01-{1 + i % 20:02d}") for i in range(3000)]
    rows += [(5000 + i, rows[7][1], 1, "2024-01-03") for i in range(30)]  # copies tie
    corpus = spark.createDataFrame(rows, "id long, embedding array<float>, rating int, day string").select(
        "id", "embedding", "rating", F.col("day").cast("date").alias("day"), F.lit("t").alias("page_content"))
    asked = [(i, rows[i * 31 % 3000][1], "1,2" if i % 2 else "3", "2024-01-02", "2024-01-12" if i % 7 else "2024-01-01") for i in range(60)]
    requests = spark.createDataFrame(asked, "request_id long, embedding array<float>, rating string, start_date string, end_date string")
    as_rows = lambda d: sorted((r.request_id, r["rank"], r.id, r.score) for r in d.collect())
    want = as_rows(retrieval.knn_filtered(requests, corpus))
    assert as_rows(retrieval.knn_ivf(requests, corpus)) == want
    assert as_rows(retrieval.knn_ivf(requests, corpus, cells=3, probes=1, block_rows=100, block_queries=7)) == want
    scored = [r.scored for r in retrieval.knn_ivf(requests, corpus, cells=80, probes=2, counts=True).collect()]
    assert sum(scored) / len(scored) < 0.1 * len(rows)
    assert retrieval.knn_ivf(requests, corpus.limit(0)).count() == 0 and retrieval.knn_ivf(requests.limit(0), corpus).count() == 0


def test_a_block_of_requests_is_scored_in_parts():
    rng = np.random.default_rng(3)
    vectors = lambda n: list(rng.normal(size=(n, 8)).astype("float32"))
    day = [date(2024, 1, 1)]
    c = pd.DataFrame({"id": range(20_000), "vec": vectors(20_000), "rating": 1, "day": day * 20_000, "cell": 0, "angle": 0.5})
    q = pd.DataFrame({"query_id": range(1_000), "qvec": vectors(1_000), "ratings": [[1, 2]] * 1_000, "first_day": day * 1_000,
                      "last_day": day * 1_000, "least": -2.0, "cell": 0, "angle": 0.5})
    tracemalloc.start()
    got = retrieval._best_of_cell(3)(q, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    scores = np.round(retrieval._unit(q["qvec"]) @ retrieval._unit(c["vec"]).T, retrieval.SCORE_DIGITS)
    assert (got["score"].to_numpy().reshape(1_000, 3) == -np.sort(-scores, axis=1)[:, :3]).all() and got["scored"].sum() == 20_000_000
    assert peak < 150e6, peak


@pytest.mark.parametrize("block_words", [7, 400_000])
def test_similar_questions_in_blocks_agree_with_brute_force(spark, block_words):
    random.seed(9)
    words = ["the"] * 8 + [f"w{i}" for i in range(25)]
    text = lambda: " ".join(random.choices(words, k=random.randrange(0, 7)))
    old = [(i, t, f"query {i}") for i, t in enumerate([text() for _ in range(60)] + ["the", "", "?", None, "w1 w2", "W2, w1", "w1 w2"])]
    new = [(1000 + i, t) for i, t in enumerate([text() for _ in range(30)] + ["unheard of", "", "the", None, "w1 w2", "w1 w2"])]
    first = {}
    for i, t, _ in old:
        if t is not None:
            first.setdefault(t, i)
    split = lambda t: [w for w in re.split(r"[^\w']+", t.lower()) if w]
    df = Counter(w for t in first for w in set(split(t)))

    def unit(t):
        v = {w: n * math.log((len(first) + 1) / (df[w] + 1)) for w, n in Counter(split(t)).items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()} if length else {}

    vectors, want = {i: unit(t) for t, i in first.items()}, set()
    for i, t in new:
        if t is not None:
            v = unit(t)
            scored = sorted((-round(sum(x * c.get(w, 0) for w, x in v.items()), 9), j) for j, c in vectors.items())
            want |= {(i, rank, j, f"query {j}") for rank, (_, j) in enumerate(scored[:5], 1)}
    got = retrieval.similar_questions(spark.createDataFrame(new, "question_id long, text string"),
                                      spark.createDataFrame(old, "question_id long, text string, query string"), block_words=block_words)
    assert {(r.question_id, r["rank"], r.example_id, r["query"]) for r in got.collect()} == want
