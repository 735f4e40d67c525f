"""Secret scan with corpus-wide ownership: widely copied examples against owner-specific credentials."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelens.llm.common import row_key, stored

KINDS = ("assign", "access", "hex", "example", "live")
EXAMPLE_OWNERS = 4         # a value that so many owners, or half of them all, hold is a copied example
EXAMPLE_REPOSITORIES = 20  # so is one in so many repositories of more than one owner
SALTS = 32                 # parts into which the holders of one value are dealt
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")  # a run starts where no such character stands before
FOUND = "array<struct<start:int,kind:int,end:int,value_start:int,value_end:int,hash:string>>"


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) of the three patterns, leftmost and non-overlapping per kind;
    too short matches are dropped without another try. Sorted by start, then kind."""
    found = [(m.start(), 0, m.end(), m.start(1), m.end(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end(), *m.span()) for m in HEX.finditer(text)]
    return sorted(found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()),
                               ("value_start", pa.int32()), ("value_end", pa.int32()), ("hash", pa.string())]))
    for batch in batches:
        spans = []
        for text in batch.column(3):
            text = text.as_py() or ""
            spans.append([{"start": s, "kind": k, "end": e, "value_start": a, "value_end": b,
                           "hash": hashlib.sha256(text[a:b].encode()).hexdigest()} for s, k, e, a, b in base_spans(text)])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, kind)], names=["rid", "doc_id", "source", "spans"])


def span_text(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of sorted (start, kind, end) structs, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _parts(spans: Column, start: str = "start", end: str = "end", kind=None) -> Column:
    return F.transform(spans, lambda s: F.struct(s[start].alias("start"), (s["kind"] if kind is None else kind(s)).alias("kind"),
                                                 s[end].alias("end")))


def ownership(found: DataFrame) -> DataFrame:
    """hash, repositories, owners: documents and sources that hold a value. Counts come from distinct pairs, each
    aggregated before the shuffle, so a value that everybody copies is no heavy group. A null source owns nothing."""
    held = found.select("rid", "source", F.explode_outer("spans.hash").alias("hash")).filter("hash is not null").distinct()
    by_owner = held.groupBy("hash", "source").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count("source").alias("owners"))


def examples_of(found: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """hash: the values that are copied examples. With N owners in the corpus that is a value of at least
    min(example_owners, half of N, rounded up) owners, but never of less than two; or one in at least
    ``example_repositories`` repositories of two owners or more. Where N is below two, owners tell nothing, and the
    repositories alone decide."""
    all_owners = found.filter("source is not null").select("source").distinct().count()
    needed = max(2, min(example_owners, (all_owners + 1) // 2))
    spread = F.col("owners") >= (2 if all_owners > 1 else 0)
    copied = (F.col("owners") >= needed) | (spread & (F.col("repositories") >= example_repositories))
    return ownership(found).filter(copied).select("hash")


def secrets(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, n_assign, n_access, n_hex, base_sha256, spans,
    n_live, n_example.

    Besides the pattern spans, each secret value gets a span ``example`` when the corpus shows it to be copied widely
    (``examples_of``), and ``live`` otherwise. A document is a repository, its source the owner. Null text is
    empty; a null source counts as no owner; rows with one doc_id and text are one repository. Whole texts are
    scanned. Other columns are not read. An empty table gives no rows."""
    found = stored(docs.select(row_key(F.col("doc_id"), F.col("text")).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                               F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
                   .mapInArrow(_scan, f"rid string, doc_id long, source string, spans {FOUND}"), "secret-spans")
    copied = examples_of(found, example_owners, example_repositories).withColumn(
        "salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    held = (found.select("rid", F.explode_outer("spans.hash").alias("hash")).filter("hash is not null").distinct()
            .withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")))
    examples = held.join(copied, ["hash", "salt"]).groupBy("rid").agg(F.collect_set("hash").alias("examples"))
    rows = found.join(examples, "rid", "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))
    base = _parts(F.col("spans"))
    judged = _parts(F.col("spans"), "value_start", "value_end",
                    lambda s: F.when(F.array_contains("examples", s["hash"]), 3).otherwise(4))
    count = lambda column, k: F.size(F.filter(column, lambda s: s["kind"] == k)).cast("long")
    rows = rows.withColumn("base", base).withColumn("judged", F.array_distinct(judged))
    return rows.select(
        "doc_id", count(F.col("base"), 0).alias("n_assign"), count(F.col("base"), 1).alias("n_access"),
        count(F.col("base"), 2).alias("n_hex"), F.sha2(span_text(F.col("base"), KINDS), 256).alias("base_sha256"),
        span_text(F.array_sort(F.concat("base", "judged")), KINDS).alias("spans"),
        count(F.col("judged"), 4).alias("n_live"), count(F.col("judged"), 3).alias("n_example"))
