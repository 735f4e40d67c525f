"""Language identification: family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 4000    # labelled rows that the model is fitted on, spread evenly over the languages
LEAST_ROWS = 8        # but so many of each language at least, where it has them
DIM = 4096            # buckets of the byte n-grams
STEP = 1 << 20        # bytes of a text counted at once
UNKNOWN = "und"

# Language families by ISO 639-1 code; a label not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "uralic": "fi et hu".split(), "turkic": "tr az kk uz".split(), "baltic": "lt lv".split(),
    "indic": "hi mr ne bn gu pa ur".split(), "semitic": "ar he mt am".split(),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
_LETTER = re.compile(r"[^\W\d_]")


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], f"only {lang}")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


_KIND = np.arange(256, dtype=np.uint32)
_KIND[:128] = [ord(chr(i).lower()) if chr(i).isalpha() else 32 for i in range(128)]


def _counts(text: str) -> np.ndarray:
    """Counts of byte 1-, 2- and 3-grams over the whole text, hashed; ASCII other than letters is space."""
    raw = text.lower().encode("utf-8", "replace")
    total = np.zeros(DIM, np.int64)
    for at in range(0, len(raw), STEP):
        b = _KIND[np.frombuffer(raw, np.uint8)[max(0, at - 2):at + STEP]]  # two bytes more, for n-grams across
        two = b[:-1] * np.uint32(256) + b[1:]
        three = two[:-1] * np.uint32(256) + b[2:]
        for grams, salt, seen in ((b, 1, 2), (two, 3, 1), (three, 7, 0)):
            index = (grams + np.uint32(salt)) * np.uint32(2654435761) >> np.uint32(20)
            total += np.bincount(index[seen if at else 0:], minlength=DIM)
    return total


def features(text: str | None) -> np.ndarray:
    x = np.sqrt(_counts(text or "").astype(np.float32))
    return x / max(float(np.linalg.norm(x)), 1e-9)


@dataclass
class Model:
    languages: list[str]
    families: list[str]
    pairs: list[tuple[int, int]]   # languages of one family: the first has the positive side
    weights: np.ndarray            # DIM + 1 rows; a column per family, then per pair

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the most likely family, then the votes of its pairs, ties by their margins."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        out = features(text) @ self.weights[:-1] + self.weights[-1]
        of_family = np.exp(out[:len(self.families)] - out[:len(self.families)].max())
        of_family /= of_family.sum()
        best = int(of_family.argmax())
        members = [i for i, lang in enumerate(self.languages) if family(lang) == self.families[best]]
        votes = {i: [0, 0.0] for i in members}
        for (i, j), margin in zip(self.pairs, out[len(self.families):]):
            if i in votes:
                votes[i if margin >= 0 else j][0] += 1
                votes[i][1] += margin
                votes[j][1] -= margin
        winner = max(members, key=lambda i: (*votes[i], -i))
        sure = 1 / (1 + np.exp(-np.clip(2 * votes[winner][1] / max(1, len(members) - 1), -30, 30)))
        return self.languages[winner], float(of_family[best] * (sure if len(members) > 1 else 1.0))


def _descend(x: np.ndarray, w: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    """Adam on the whole (bounded) sample."""
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient(x, w) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def train(x: np.ndarray, langs: list[str]) -> Model:
    return _train(np.hstack([x, np.ones((len(x), 1), np.float32)]), langs)


def _train(x: np.ndarray, langs: list[str]) -> Model:
    """``x`` has a last column of ones. No other array of its size is made but the rows of two languages."""
    if not langs:
        return Model([], [], [], np.zeros((DIM + 1, 0), np.float32))
    languages = sorted(set(langs))
    y = np.array([languages.index(v) for v in langs], int)
    families = sorted({family(v) for v in languages})
    fam = np.array([families.index(family(v)) for v in languages], int)
    goal = np.eye(len(families), dtype=np.float32)[fam[y]]

    def softmax(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return x.T @ (p / p.sum(axis=1, keepdims=True) - goal) / len(x)

    columns = [_descend(x, np.zeros((DIM + 1, len(families)), np.float32), softmax, 150, 0.2)]
    pairs = [(i, j) for i, j in combinations(range(len(languages)), 2) if fam[i] == fam[j]]
    for i, j in pairs:
        rows = (y == i) | (y == j)
        sign = np.where(y[rows] == i, 1.0, -1.0).astype(np.float32)[:, None]

        def hinge(x: np.ndarray, w: np.ndarray, sign=sign) -> np.ndarray:
            return x.T @ (-2 * sign * np.maximum(0, 1 - sign * (x @ w))) / len(x)

        columns.append(_descend(x[rows], np.zeros((DIM + 1, 1), np.float32), hinge, 150, 0.1))
    return Model(languages, families, pairs, np.hstack(columns).astype(np.float32))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def drawn(wanted: int, rows: int) -> int:
    """The largest hash of an id that is drawn, so that about ``wanted`` of ``rows`` are: the whole 64 bits count,
    so a small share of very many rows is still a share."""
    return min((1 << 64) * min(wanted, rows) // rows, (1 << 64) - 1) - (1 << 63)


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from text and non-null lang of rows that are not held out: about ``sample_rows`` of them (or LEAST_ROWS
    a language, if that is more), chosen by a hash of doc_id alike at every size. All labels are learnt. Whole texts
    are read; only their features, of one size, reach the driver. Not learnt from: null doc_id, texts that are null or
    without a letter. A repeated row counts as often as it is there. An empty table, or one without labels, gives a
    model without languages."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(
        ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").count().collect()
    if not sizes:
        return train(np.zeros((0, DIM), np.float32), [])
    wanted = max(LEAST_ROWS, sample_rows // len(sizes))
    chosen = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], drawn(wanted, r["count"]))])
    sample = rows.filter(F.xxhash64("doc_id") <= chosen[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            x = pa.array([features(t).astype(np.float16).tobytes() for t in texts], pa.binary())
            good = pa.array([has_letter(t) for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), x], names=["doc_id", "lang", "x"]).filter(good)

    got = sample.mapInArrow(run, "doc_id long, lang string, x binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["lang"], bytes(r["x"])))
    langs = [r["lang"] for r in got]
    x = np.ones((len(got), DIM + 1), np.float32)
    for at in reversed(range(len(got))):
        x[at, :DIM] = np.frombuffer(got.pop()["x"], np.float16)  # a row goes as its features are taken
    return _train(x, langs)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score. Every whole text is read. Null text, or one
    without a letter, is ``und`` with score 0, as is every text where nothing could be learnt. A null doc_id counts
    as not held out. Only text decides; other columns are not read. Repeated rows get equal results."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def drop_unidentified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, in which a language is found. Where no language was learnt, those with a
    letter stay."""
    def run(texts):
        return texts.map(lambda t: isinstance(t, str) and has_letter(t)
                         and (not model.languages or model.predict(t)[0] != UNKNOWN))

    return docs.filter(F.pandas_udf(run, "boolean", functionType=F.PandasUDFType.SCALAR)("text"))
