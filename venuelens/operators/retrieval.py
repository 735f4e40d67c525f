"""Nearest reviews per request: filtered exact search, an approximate form, and text vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelens.functions.text import each
from venuelens.operators.skew import top_k
from venuelens.operators.themes import day_list
from venuelens.session import shared_dir

SCORE_DIGITS = 9


def request_cells(requests: DataFrame) -> DataFrame:
    """One row per request, rating and day it accepts; a range that ends before it starts gives none."""
    days = day_list(F.col("start_date").cast("date"), F.col("end_date").cast("date"))
    ratings = F.array_distinct(F.transform(F.split("rating", ",", -1), lambda r: F.trim(r).try_cast("int")))
    return each(each(requests, ratings, "rating"), days, "day")


def retrieval_filter(corpus: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, review) pairs that pass the request's rating and day lists, by an equi-join."""
    return (request_cells(requests).select("request_id", "rating", "day")
            .join(corpus.select("id", "rating", "day"), ["rating", "day"]))


def _unit(rows: pd.Series) -> np.ndarray:
    m = np.stack(rows.to_numpy()).astype(np.float64)
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(length == 0, 1.0, length)


def _best_of_block(k: int):
    """Scores a block of queries against a block of the corpus and keeps ``k`` per query."""
    def run(queries: pd.DataFrame, corpus: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or corpus.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype(
                {"query_id": "int64", "id": "int64", "score": "float64"})
        ids = corpus["id"].to_numpy()
        scores = np.round(_unit(queries["qvec"]) @ _unit(corpus["vec"]).T, SCORE_DIGITS)
        by_id = np.argsort(ids, kind="stable")
        order = np.argsort(-scores[:, by_id], axis=1, kind="stable")[:, :k]
        chosen = by_id[order]
        n = chosen.shape[1]
        return pd.DataFrame({
            "query_id": np.repeat(queries["query_id"].to_numpy(), n), "id": ids[chosen].ravel(),
            "score": np.take_along_axis(scores, chosen, axis=1).ravel()})
    return run


def blocked_top_k(queries: DataFrame, corpus: DataFrame, cells: Sequence[str], k: int,
                  block_rows: int = 20_000, block_queries: int = 1_000) -> DataFrame:
    """Exact best ``k`` of ``corpus`` (id, vec, cells) per query (query_id, qvec, cells) by cosine.

    Each cell is cut into corpus blocks and query blocks of bounded size, whatever its share of
    the rows. A task multiplies one pair of blocks and returns at most ``k`` rows per query, so
    pairs are never shuffled or stored. Neither side is broadcast or brought to the driver."""
    cells = list(cells)

    def sizes(df: DataFrame, per: int, name: str) -> DataFrame:
        return df.groupBy(*cells).agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias(name))

    grid = sizes(corpus.select(*cells), block_rows, "nc").join(
        sizes(queries.select(*cells), block_queries, "nq"), cells)

    def own(c: str, n: str) -> Column:
        return F.pmod(F.xxhash64(c), F.col(n)).cast("int")

    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    c = (corpus.join(grid, cells).withColumn("cb", own("id", "nc")).withColumn("qb", upto("nq"))
         .select(*cells, "cb", "qb", "id", "vec"))
    q = (queries.join(grid, cells).withColumn("qb", own("query_id", "nq")).withColumn("cb", upto("nc"))
         .select(*cells, "cb", "qb", "query_id", "qvec"))
    keys = [*cells, "cb", "qb"]
    found = (q.groupBy(*keys).cogroup(c.groupBy(*keys))
             .applyInPandas(_best_of_block(k), "query_id long, id long, score double"))
    return top_k(found, ["query_id"], [F.col("score").desc(), F.col("id")], k)


def knn_filtered(queries: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most similar reviews per request among those passing its filter, with metadata.
    The text and metadata are joined to the winners only."""
    cells = ["rating", "day"]
    q = request_cells(queries).select(F.col("request_id").alias("query_id"), F.col("embedding").alias("qvec"), *cells)
    c = corpus.select("id", F.col("embedding").alias("vec"), *cells)
    hits = blocked_top_k(q, c, cells, k).withColumnRenamed("query_id", "request_id")
    return _with_content(hits, corpus)


def _with_content(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    return hits.join(corpus.select("id", "page_content", "rating", "day"), "id").select(
        "request_id", "rank", "id", "page_content", "rating", "day", "score")


SAMPLE_VECTORS = 20_000  # vectors, drawn by a hash of their id, that centroids are fitted on
CELLS = 4096             # at most; sqrt of the number of vectors otherwise


def fit_centroids(corpus: DataFrame, cells: int | None = None, sample: int = SAMPLE_VECTORS, rounds: int = 8) -> np.ndarray:
    """Unit centroids of spherical k-means, fitted on a sample of about ``sample`` vectors (at most that many reach the
    driver). They only steer the search: any centroids give the same results."""
    n = corpus.count()
    share = min((1 << 64) * min(sample, n) // max(n, 1), (1 << 64) - 1) - (1 << 63)
    rows = corpus.filter(F.xxhash64("id") <= share).select("id", "embedding").orderBy("id").limit(sample).toPandas()
    if rows.empty:
        return np.zeros((0, 0))
    x = _unit(rows["embedding"])
    k = min(cells or int(np.ceil(np.sqrt(n))), CELLS, len(x))
    c = x[np.random.default_rng(11).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(length > 0, sums / np.where(length > 0, length, 1), c)
    return c


PAIRS = 1 << 20  # cells of a score matrix that a task holds at once


def _parts(n: int, width: int) -> list[slice]:
    """``n`` rows in parts whose matrices of ``width`` columns stay below ``PAIRS`` cells."""
    step = max(1, PAIRS // max(width, 1))
    return [slice(at, at + step) for at in range(0, n, step)]


def inverted_file(corpus: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows of ``corpus`` with their cell (the nearest centroid) and the angle to it."""
    def run(batches):
        for rows in batches:
            if len(rows):
                x, cell, cosine = _unit(rows["embedding"]), np.zeros(len(rows), np.int32), np.zeros(len(rows))
                for part in _parts(len(rows), len(centroids)):
                    near = x[part] @ centroids.T
                    cell[part], cosine[part] = near.argmax(axis=1), near.max(axis=1)
                yield rows.assign(cell=cell, angle=np.arccos(np.clip(cosine, -1, 1)))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in corpus.schema)
    return corpus.mapInPandas(run, f"{fields}, cell int, angle double")


_FOUND = {"query_id": "int64", "id": "int64", "score": "float64", "scored": "int64"}


def _found(parts: list[tuple]) -> pd.DataFrame:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [[]] * len(_FOUND)
    return pd.DataFrame(dict(zip(_FOUND, columns))).astype(_FOUND)


def _first_k(q_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, good: np.ndarray, kept: np.ndarray, k: int) -> tuple:
    """The ``k`` best of the ``kept`` pairs of each query, and beside its first one how many pairs were ``good``. A query
    with good pairs of which none is kept gives a row without id."""
    row, col = np.nonzero(kept)
    score = np.round(scores[row, col], SCORE_DIGITS)
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, col, score, place = (x[place < k] for x in (row, col, score, place))
    n = good.sum(axis=1)
    bare = np.flatnonzero((n > 0) & ~kept.any(axis=1))
    return (np.concatenate([q_ids[row], q_ids[bare]]), np.concatenate([ids[col], np.full(len(bare), -1)]),
            np.concatenate([score, np.full(len(bare), np.nan)]), np.concatenate([np.where(place == 0, n[row], 0), n[bare]]))


def _best_of_cell(k: int):
    """Scores the requests of a block against the vectors of a block, those that pass a request's filter; returns ``k``
    per request and how many were scored."""
    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return _found([])
        qv, cv, ids, q_ids = _unit(q["qvec"]), _unit(c["vec"]), c["id"].to_numpy(), q["query_id"].to_numpy()
        day, first, last = (x.to_numpy(dtype="datetime64[D]") for x in (c["day"], q["first_day"], q["last_day"]))
        ratings = [(np.array([r in own for own in q["ratings"]]), (c["rating"] == r).to_numpy()) for r in c["rating"].dropna().unique()]
        out = []
        for part in _parts(len(q), len(c)):
            good = np.zeros((len(q_ids[part]), len(c)), bool)
            for wants, has in ratings:
                good |= wants[part, None] & has
            good &= (day >= first[part, None]) & (day <= last[part, None])
            out.append(_first_k(q_ids[part], ids, qv[part] @ cv.T, good, good, k))
        return _found(out)
    return run


def _best_beyond(k: int, centroids: np.ndarray, radius: np.ndarray):
    """Scores the requests of a block against the vectors of a block, all of a rating and day that the requests accept:
    cells not probed before, if their widest angle leaves room for a request's threshold, and in them the vectors
    whose own distance bound does. Returns ``k`` per request and how many were scored."""
    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return _found([])
        near = np.stack(q["near"].to_numpy())
        order = np.argsort(near[:, 0], kind="stable")  # requests that want the same cells stand together
        q, near = q.iloc[order], near[order]
        qv, cv, ids, q_ids = _unit(q["qvec"]), _unit(c["vec"]), c["id"].to_numpy(), q["query_id"].to_numpy()
        least = q["least"].to_numpy()[:, None]
        held, own = np.unique(c["cell"].to_numpy(), return_inverse=True)
        # two vectors are at least as far apart as their angles to the centroid differ: cos(a - b), by its sum
        cos_c, sin_c = np.cos(c["angle"].to_numpy()), np.sin(c["angle"].to_numpy())
        out = []
        for part in _parts(len(q), len(c) + len(held)):
            cos_q = np.clip(qv[part] @ centroids[held].T, -1, 1)
            wanted = np.cos(np.maximum(np.arccos(cos_q) - radius[held], 0)) >= least[part] - 1e-6
            for probed in near[part].T:
                wanted &= probed[:, None] != held
            cols = np.flatnonzero(wanted.any(axis=0)[own])
            if not len(cols):
                continue
            at = own[cols]
            bound = cos_q[:, at] * cos_c[cols] + np.sqrt(1 - cos_q * cos_q)[:, at] * sin_c[cols]
            good = wanted[:, at] & (bound >= least[part] - 1e-6)
            scores = qv[part] @ cv[cols].T
            out.append(_first_k(q_ids[part], ids[cols], scores, good, good & (scores >= least[part] - 1e-8), k))
        return _found(out)
    return run


def knn_ivf(queries: DataFrame, corpus: DataFrame, k: int = 10, cells: int | None = None, probes: int = 4,
            block_rows: int = 20_000, block_queries: int = 5_000, counts: bool = False) -> DataFrame:
    """The rows of ``knn_filtered`` through an inverted file: vectors lie in the cell of their nearest centroid. A request
    first probes the ``probes`` nearest cells; its ``k``-th score there is a threshold, and of the other cells it only
    probes those in which the distance bound (the cell's widest angle about its centroid) leaves room for a better
    score, and in them scores only vectors whose own bound does. So nothing is missed, and how much is skipped depends on
    how the vectors cluster. The other cells are met by rating and day, so a request travels once for each rating and
    day it accepts, however many cells it wants. Cells and requests are cut into blocks of bounded size, and a task
    multiplies them in parts. With ``counts`` the result is one row per request with the number of vectors scored for
    it. A request whose range ends before it starts gives none."""
    centroids = fit_centroids(corpus, cells)
    schema = "request_id long, rank int, id long, page_content string, rating int, day date, score double"
    if not len(centroids):
        return corpus.sparkSession.createDataFrame([], "request_id long, scored long" if counts else schema)
    shared_dir(corpus.sparkSession)
    index = inverted_file(corpus.select("id", "rating", "day", F.col("embedding").alias("embedding")), centroids).withColumnRenamed(
        "embedding", "vec").checkpoint()
    # one row per cell, at most CELLS
    widest = {r["cell"]: r["w"] for r in index.groupBy("cell").agg(F.max("angle").alias("w")).collect()}
    held = np.array(sorted(widest), np.int32)
    radius = np.zeros(len(centroids))
    radius[held] = [widest[c] for c in held.tolist()]

    def nearest(batches):
        for rows in batches:
            if len(rows):
                x = _unit(rows["qvec"])
                near = [held[np.argsort(-(x[part] @ centroids[held].T), axis=1, kind="stable")[:, :probes]] for part in _parts(len(x), len(held))]
                yield rows.assign(near=list(np.concatenate(near)))

    ratings = F.filter(F.array_distinct(F.transform(F.split("rating", ",", -1), lambda r: F.trim(r).try_cast("int"))), lambda r: r.isNotNull())
    asked = (queries.select(F.col("request_id").alias("query_id"), F.col("embedding").alias("qvec"), ratings.alias("ratings"),
                            F.col("start_date").cast("date").alias("first_day"), F.col("end_date").cast("date").alias("last_day"))
             .filter("last_day >= first_day"))
    # kept, so that both searches agree on which cells were probed
    asked = asked.mapInPandas(nearest, "query_id long, qvec array<float>, ratings array<int>, first_day date, last_day date, near array<int>").checkpoint()

    def scored(side: DataFrame, cells: list[str], best) -> DataFrame:
        sizes = lambda df, per, name: df.groupBy(*cells).agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias(name))
        grid = sizes(index.select(*cells), block_rows, "nc").join(sizes(side.select(*cells), block_queries, "nq"), cells)
        own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        c = index.join(grid, cells).withColumn("cb", own("id", "nc")).withColumn("qb", upto("nq")).drop("nc", "nq")
        q = side.join(grid, cells).withColumn("qb", own("query_id", "nq")).withColumn("cb", upto("nc")).drop("nc", "nq")
        keys = [*cells, "cb", "qb"]
        return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(best, "query_id long, id long, score double, scored long")

    near = scored(asked.withColumn("cell", F.explode("near")).drop("near"), ["cell"], _best_of_cell(k)).checkpoint()
    best = [F.col("score").desc(), F.col("id")]
    kth = top_k(near, ["query_id"], best, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    none = F.lit(-2.0)  # below every cosine
    days = F.sequence("first_day", "last_day")
    rest = each(each(asked.join(kth, "query_id", "left").select("query_id", "qvec", "near", F.coalesce("least", none).alias("least"),
                                                                "ratings", days.alias("days")),
                     F.col("ratings"), "rating").drop("ratings"), F.col("days"), "day").drop("days")
    found = near.unionByName(scored(rest, ["rating", "day"], _best_beyond(k, centroids, radius)))
    if counts:
        return found.groupBy(F.col("query_id").alias("request_id")).agg(F.sum("scored").alias("scored"))
    found = found.filter("not isnan(score)").drop("scored")
    return _with_content(top_k(found, ["query_id"], best, k).withColumnRenamed("query_id", "request_id"), corpus)


def answer_context(hits: DataFrame) -> DataFrame:
    """Per request the retrieved texts in rank order (at most ``k``) as one text, with their scores."""
    rows = F.sort_array(F.collect_list(F.struct("rank", "id", "score", "page_content")))
    return hits.groupBy("request_id").agg(rows.alias("r")).select(
        "request_id", F.size("r").alias("hits"),
        F.array_join(F.transform("r", lambda x: F.coalesce(x["page_content"], F.lit(""))), "\n").alias("context"),
        F.array_join(F.transform("r", lambda x: F.format_string(f"%.{SCORE_DIGITS}f", x["score"])), ",").alias("scores"))


def text_model(docs: DataFrame, n_features: int):
    """Term weights learnt from ``docs`` (text); the only state is one number per feature."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"[^\p{L}\p{N}']+"),
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=n_features),
        IDF(inputCol="tf", outputCol="weighted"),
        Normalizer(inputCol="weighted", outputCol="features")]).fit(docs)


def text_vectors(docs: DataFrame, n_features: int = 1 << 16) -> DataFrame:
    """Unit-length TF-IDF vectors per document (``doc_id``, ``text``); row-local after one pass
    for the document counts, so nothing is shuffled."""
    known = docs.filter(F.col("text").isNotNull()).select("doc_id", "text")
    return text_model(known, n_features).transform(known).select("doc_id", "features")


def term_counts(docs: DataFrame, key: str) -> DataFrame:
    """(key, term, tf): the words of each text in lower case; words are kept as they are, so none collide."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}']+"), lambda w: w != "")
    return each(docs.select(key, "text"), words, "term").groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_vectors(docs: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """(key, v): unit-length TF-IDF weights as (term, w) in term order, document counts learnt from ``known``
    (id, text). A text without words has an empty ``v``."""
    found = term_counts(known, "id").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(known.count() + 1) / (F.coalesce("df", F.lit(0)) + 1))
    made = (term_counts(docs, key).join(found, "term", "left").select(key, F.struct("term", (F.col("tf") * idf).alias("w")).alias("t"))
            .groupBy(key).agg(F.sort_array(F.collect_list("t")).alias("v")))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    made = made.withColumn("length", length).withColumn("v", F.transform("v", lambda x: F.struct(
        x["term"].alias("term"), F.when(F.col("length") > 0, x["w"] / F.col("length")).otherwise(0.0).alias("w"))))
    none = F.array().cast("array<struct<term:string,w:double>>")
    return docs.select(key).join(made, key, "left").select(key, F.coalesce("v", none).alias("v"))


def _best_of_texts(k: int):
    """Scores the questions of a block (q, term, w) against the texts of a block (id, term, w) by the postings of the
    block; returns ``k`` texts of a score above 0 per question."""
    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        code, terms = pd.factorize(c["term"])
        q = q.assign(code=pd.Index(terms).get_indexer(q["term"])).query("code >= 0").sort_values(["q", "term"])
        ids, at = np.unique(c["id"].to_numpy(), return_inverse=True)
        order = np.argsort(code, kind="stable")
        at, w, ends = at[order], c["w"].to_numpy()[order], np.searchsorted(code[order], np.arange(len(terms) + 1))
        asked, first = np.unique(q["q"].to_numpy(), return_index=True)
        q_code, q_w, out = q["code"].to_numpy(), q["w"].to_numpy(), []
        for name, lo, hi in zip(asked, first, [*first[1:], len(q)]):
            own = [slice(ends[t], ends[t + 1]) for t in q_code[lo:hi]]
            scores = np.bincount(np.concatenate([at[s] for s in own]),
                                 np.concatenate([w[s] * x for s, x in zip(own, q_w[lo:hi])]), len(ids))
            least = np.partition(scores, -k)[-k] - 1e-8 if len(ids) > k else 0.0
            near = np.flatnonzero((scores >= least) & (scores > 0))
            score = np.round(scores[near], SCORE_DIGITS)
            best = np.lexsort((ids[near], -score))[:k]
            out.append((np.full(len(best), name), ids[near[best]], score[best]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [[], [], []]
        return pd.DataFrame(dict(zip(("q", "id", "score"), columns))).astype({"q": "int64", "id": "int64", "score": "float64"})
    return run


def similar_questions(new: DataFrame, stored: DataFrame, k: int = 5, block_words: int = 400_000) -> DataFrame:
    """The ``k`` stored questions closest to each new one by TF-IDF cosine, ties to the smaller id. ``new`` has
    ``question_id`` and ``text``, ``stored`` also the ``query`` that answered it. Equal texts are scored once.

    Exact: questions and texts are cut into blocks of about ``block_words`` words of their own, and a task meets two
    blocks through the postings of one, so pairs are neither stored nor shuffled and no word is a key. The 2k smallest
    ids hold all texts of score 0 that could be among the first ``k``."""
    new = new.filter(F.col("text").isNotNull())
    stored = stored.filter(F.col("text").isNotNull())
    shared_dir(new.sparkSession)
    unique = stored.groupBy("text").agg(F.min("question_id").alias("id")).checkpoint()
    asked = new.groupBy("text").agg(F.min("question_id").alias("q")).checkpoint()

    def index(docs: DataFrame, key: str) -> DataFrame:
        return each(term_vectors(docs, key, unique), F.col("v"), "t").select(key, "t.term", "t.w").filter("w > 0").checkpoint()

    c, q = index(unique, "id"), index(asked, "q")
    blocks = lambda df: max(1, -(-df.count() // block_words))
    nc, nq = blocks(c), blocks(q)
    own = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = c.withColumn("cb", own("id", nc)).withColumn("qb", upto(nq))
    q = q.withColumn("qb", own("q", nq)).withColumn("cb", upto(nc))
    keys = ["cb", "qb"]
    near = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(_best_of_texts(k), "q long, id long, score double")
    least = [r["id"] for r in unique.orderBy("id").limit(2 * k).select("id").collect()]
    filler = asked.select("q", F.explode(F.array(*[F.lit(i) for i in least]).cast("array<long>")).alias("id"), F.lit(0.0).alias("score"))
    hits = top_k(near.unionByName(filler).groupBy("q", "id").agg(F.max("score").alias("score")), ["q"], [F.col("score").desc(), F.col("id")], k)
    examples = stored.select(F.col("question_id").alias("id"), F.col("text").alias("example"), "query")
    return (hits.join(asked, "q").join(new.select("question_id", "text"), "text").join(examples, "id")
            .select("question_id", "rank", F.col("id").alias("example_id"), "example", "query", "score"))
