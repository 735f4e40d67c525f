"""Personal data: pattern spans, and terms that reveal protected entities by corpus co-occurrence."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuelens.llm.common import row_key, stored
from venuelens.llm.secret_scan import span_text

KINDS = ("email", "ip", "card", "phone", "term")
CONTEXT = 8         # words on either side of an entity that count as seen with it
SUPPORT = 3         # different contexts in which a term and an entity must meet
DISCLOSURE = 0.5    # share of a term's documents that point to one entity
BITS = 8.0          # pointwise mutual information, in bits
FILTER_BITS = 26    # size of the bitmap that words are held against
WORDS_HELD = 200_000  # words that a task counts before it hands them on

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
WORD = re.compile(r"[^\W\d_]{3,}")
_DIGITS = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them, but sought from each ``@``: the local part is the run of its characters
    before it, back to the last match, so a long run without ``@`` costs one pass."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done:  # back over the run, in growing pieces
            piece = max(done, start - 64)
            run = LOCAL_END.search(text, piece, start)
            if run is None:
                break
            start = run.start()
            if start > piece:
                break
        domain = DOMAIN.match(text, at) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), leftmost and non-overlapping per kind; failing matches are dropped without another try."""
    found = [(s, 0, e) for s, e in _emails(text)]
    if "." in text:
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text)
                  if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_DIGITS.sub("", m[0])) <= 15]
    return sorted(found)


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode(), digest_size=8).digest(), "big", signed=True)


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """For each entity: a hash of its value, a hash of the words about it, those words. Entities are blanked first;
    the words are whole, ``CONTEXT`` on either side, however far off they stand."""
    if not spans:
        return []
    pieces, at = [], 0
    for s, _, e in spans:
        pieces += [text[at:s], " " * (e - max(s, at))] if e > at else []
        at = max(at, e)
    words = [(m.start(), m[0].lower()) for m in WORD.finditer("".join(pieces) + text[at:])]
    starts, out = [w[0] for w in words], []
    for s, kind, e in spans:
        value = text[s:e].lower() if kind == 0 else _DIGITS.sub("", text[s:e])
        left, right = bisect_left(starts, s), bisect_left(starts, e)
        before, after = ([w for _, w in words[i:j]] for i, j in ((max(0, left - CONTEXT), left), (right, right + CONTEXT)))
        out.append({"entity": _hash(KINDS[kind], value), "context": _hash(*before, "", *after), "terms": sorted({*before, *after})})
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    context_type = pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64()), ("terms", pa.list_(pa.string()))]))
    for batch in batches:
        spans, seen = [], []
        for text in batch.column(2):
            text = text.as_py() or ""
            found = base_spans(text)
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
            seen.append(contexts(text, found))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(spans, spans_type), pa.array(seen, context_type)],
                                         names=["rid", "doc_id", "base", "contexts"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(row_key(F.col("doc_id"), F.col("text")).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))


def entity_spans(docs: DataFrame) -> DataFrame:
    """rid, doc_id, base (the pattern spans), contexts; written once."""
    return stored(_rows(docs).mapInArrow(
        _scan, "rid string, doc_id long, base array<struct<start:int,kind:int,end:int>>, "
               "contexts array<struct<entity:long,context:long,terms:array<string>>>"), "personal-spans")


def suspects(found: DataFrame) -> DataFrame:
    """term, entity, both, entity_documents: every term and entity that meet in at least SUPPORT different contexts,
    so that copies of one passage are no evidence; both counts the documents in which the term stands by the entity,
    entity_documents those that hold the entity. A row per word about an entity, never per pair of words, aggregated
    before each shuffle."""
    seen = found.select(F.monotonically_increasing_id().alias("row"), F.explode_outer("contexts").alias("c")).filter(
        "c is not null").select("row", "c.entity", "c.context", "c.terms")
    term = lambda df: df.withColumn("term", F.explode_outer("terms")).drop("terms").filter("term is not null")
    met = (term(seen.select("entity", "context", "terms").dropDuplicates(["entity", "context"]))
           .groupBy("term", "entity").agg(F.count(F.lit(1)).alias("contexts")).filter(F.col("contexts") >= SUPPORT))
    inside = found.select(F.expr("""array_distinct(flatten(transform(contexts, c -> transform(c.terms,
        t -> named_struct('term', t, 'entity', c.entity)))))""").alias("pairs"))
    both = (inside.select(F.explode_outer("pairs").alias("p")).filter("p is not null").select("p.term", "p.entity")
            .groupBy("term", "entity").agg(F.count(F.lit(1)).alias("both")))
    entities = (found.select(F.explode_outer(F.array_distinct("contexts.entity")).alias("entity")).filter("entity is not null")
                .groupBy("entity").agg(F.count(F.lit(1)).alias("entity_documents")))
    return met.join(both, ["term", "entity"]).join(entities, "entity").select("term", "entity", "both", "entity_documents")


def term_filter(terms: DataFrame) -> bytes | None:
    """A bitmap of 2 ** FILTER_BITS bits, set at the CRC-32 of each term; None without terms. Spark builds it in
    pieces of 4 KB, so the driver gets 8 MB at most, however many terms there are. Words it lets through in vain are
    removed by a join with the terms."""
    bit = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(1 << FILTER_BITS)) + 1  # buckets and their bits count from 1
    pieces = (terms.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("piece"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect())
    if not pieces:
        return None
    whole = bytearray(1 << FILTER_BITS - 3)
    for r in pieces:
        at = (r["piece"] - 1) * len(r["bits"])
        whole[at:at + len(r["bits"])] = r["bits"]
    return zlib.compress(bytes(whole), 1)


def _passes(packed: bytes) -> Callable[[str], bool]:
    bits = zlib.decompress(packed)

    def test(word: str) -> bool:
        b = zlib.crc32(word.encode()) % (1 << FILTER_BITS)
        return bool(bits[b >> 3] >> (b & 7) & 1)
    return test


def _document_counts(docs: DataFrame, packed: bytes) -> DataFrame:
    """(term, n): rows of ``docs`` that hold a word of the filter, counted inside each task; a task that meets many
    words hands its counts on and starts anew."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes, counts = _passes(packed), Counter()
        known: dict[str, bool] = {}

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                               names=["term", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                for word in set(WORD.findall((text.as_py() or "").lower())):
                    good = known.get(word)
                    if good is None:
                        if len(known) >= WORDS_HELD:
                            known.clear()
                        good = known[word] = passes(word)
                    if good:
                        counts[word] += 1
                if len(counts) >= WORDS_HELD:
                    yield flush()
        yield flush()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term string, n long")


def disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The terms that disclose an entity: over the whole corpus the documents in which the term stands by that entity
    are at least DISCLOSURE of those with the term, and their pointwise mutual information reaches BITS, all four
    counts in documents. Every pair of a term and an entity is tested; one is enough. Such a term is in at most
    a 2 ** (BITS - 1)-th of all documents, so no disclosing term is a heavy key."""
    suspected = stored(suspects(found), "suspect-terms")
    packed = term_filter(suspected)
    if packed is None:
        return suspected.select("term")
    spread = (_document_counts(docs, packed).join(suspected.select("term").distinct(), "term")
              .groupBy("term").agg(F.sum("n").alias("documents")))
    n = F.greatest("documents", "both")
    bits = F.log2(F.col("both") * F.lit(float(max(1, found.count()))) / (n * F.col("entity_documents")))
    return stored(suspected.join(spread, "term").filter((F.col("both") / n >= DISCLOSURE) & (bits >= BITS)).select("term").distinct(),
                  "disclosing-terms")


def term_places(docs: DataFrame, terms: DataFrame, masked: bool = False) -> DataFrame:
    """rid, term, start, end: every occurrence of the terms in any document; ``masked`` also gives the words that
    stand apart only once entities are masked, with offsets of the masked text."""
    packed = term_filter(terms)
    if packed is None:
        return docs.sparkSession.createDataFrame([], "rid string, term string, start int, end int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = _passes(packed)
        for batch in batches:
            out = ([], [], [], [])
            for rid, text in zip(batch.column(0), batch.column(2)):
                text = text.as_py() or ""
                for part in {text, mask(text)} if masked else (text,):
                    good = {w for w in set(WORD.findall(part.lower())) if passes(w)}
                    for m in WORD.finditer(part) if good else ():
                        if (term := m[0].lower()) in good:
                            for column, value in zip(out, (rid.as_py(), term, m.start(), m.end())):
                                column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, (pa.string(), pa.string(), pa.int32(), pa.int32()))],
                names=["rid", "term", "start", "end"])

    return _rows(docs).mapInArrow(run, "rid string, term string, start int, end int").join(terms, "term", "left_semi")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term.

    Null text is empty. ``spans`` also holds a span ``term`` for every occurrence, in any document, of a word that
    discloses a protected entity (``disclosing_terms``). Rows with one doc_id and text share their result; a null
    doc_id is kept; other columns are not read; an empty table gives no rows. Offsets are code points."""
    found = entity_spans(docs)
    terms = term_places(docs, disclosing_terms(docs, found)).distinct().groupBy("rid").agg(F.collect_list(
        F.struct("start", F.lit(4).alias("kind"), "end")).alias("terms"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    rows = found.select("rid", "doc_id", "base").join(terms, "rid", "left").withColumn("terms", F.coalesce("terms", none))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select("doc_id", *[count(k) for k in range(4)], F.sha2(span_text(F.col("base"), KINDS), 256).alias("base_sha256"),
                       span_text(F.array_sort(F.concat("base", "terms")), KINDS).alias("spans"), F.size("terms").cast("long").alias("n_term"))


def _placed(text: str, m: re.Match) -> bool:
    return m[0] in KINDS and text[max(0, m.start() - 1):m.end() + 1] == f"<{m[0]}>"


def mask(text: str, terms: frozenset = frozenset()) -> str:
    """Entities become ``<kind>``, disclosing terms ``<term>``; overlapping spans become one. Repeated until no
    pattern matches, as cutting a match out can leave another one behind."""
    while True:
        spans = base_spans(text)
        if terms and not terms.isdisjoint(WORD.findall(text.lower())):
            spans = sorted(spans + [(m.start(), 4, m.end()) for m in WORD.finditer(text)
                                    if m[0].lower() in terms and not _placed(text, m)])
        if not spans:
            return text
        out, at = [], 0
        for s, kind, e in spans:
            if s >= at:
                out += [text[at:s], f"<{KINDS[kind]}>"]
            at = max(at, e)
        text = "".join(out) + text[at:]


def sanitised(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with ``text`` masked; a text without personal data is left as it is, a
    null text stays null. Rows that share doc_id and text are masked alike. An empty table gives no rows."""
    terms = disclosing_terms(docs, entity_spans(docs))
    held = term_places(docs, terms, masked=True).groupBy("rid").agg(F.collect_set("term").alias("__terms"))

    @F.pandas_udf("string")
    def masked(texts: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([mask(t, frozenset(own if own is not None else ())) if isinstance(t, str) else None
                          for t, own in zip(texts, terms)], dtype=object)

    rows = docs.join(held, row_key(docs["doc_id"], docs["text"]) == held["rid"], "left")
    return rows.select(*[masked(docs["text"], F.col("__terms")).alias("text") if c == "text" else docs[c] for c in docs.columns])
