"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuelens.llm.common import ascii_lower, row_key, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13     # words of a window
SHINGLE = 5     # words of a token of the set join
BROADCAST_ROWS = 2_000_000  # distinct benchmark shingles, 8 bytes each, up to which they are broadcast


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, A-Z lower-cased; none for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATORS, -1), ""),
                      F.array().cast("array<string>"))


def _starts(count: Column) -> Column:
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def _hashes(hashed: Column, n: Column, size: int) -> Column:
    """A hash of each run of ``size`` words, from the hashes of the words."""
    return F.transform(_starts(n - (size - 1)), lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(size)]))


def _run(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, size), " ")


def _windows(benchmark: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(windows: w, item_id) and (shingles of distinct windows: w, len, size, off, g, h)."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    length = F.least(F.col("n"), F.lit(window))
    placed = items.filter("n > 0").select("item_id", "words", length.alias("len"), F.explode_outer(
        F.sequence(F.lit(0), F.col("n") - length)).alias("start"))
    whole = stored(placed.select("item_id", "len", _run(F.col("words"), F.col("start"), F.col("len")).alias("w"))
                   .distinct(), "windows")
    size = F.least(F.col("len"), F.lit(shingle))
    cut = (whole.select("w", "len").distinct().withColumn("words", F.split("w", " ")).withColumn("size", size)
           .select("w", "len", "size", "words", F.explode_outer(_starts(F.col("len") - F.col("size") + 1)).alias("off")))
    hashed = F.transform(F.slice("words", F.col("off") + 1, F.col("size")), lambda w: F.xxhash64(w))
    by_size = reduce(lambda c, k: c.when(F.col("size") == k, F.xxhash64(*[F.get(hashed, F.lit(j)) for j in range(k)])),
                     range(1, shingle + 1), F.when(F.lit(False), F.lit(0).cast("long")))
    tokens = cut.select("w", "len", "size", "off", _run(F.col("words"), F.col("off"), F.col("size")).alias("g"),
                        by_size.alias("h"))
    return whole.select("w", "item_id"), stored(tokens, "window-shingles")


def _matches(docs: DataFrame, tokens: DataFrame, shingle: int) -> DataFrame:
    """One pass over the texts: for each document a row with ``pos`` -1, and a row for each of its shingles that
    the benchmark has: rid, doc_id, n_words, pos, g."""
    # at most ``shingle`` values; sizes below ``shingle`` come from items of fewer words
    sizes = sorted((r["size"] for r in tokens.select("size").distinct().collect()), reverse=True) or [shingle]
    base = docs.select("doc_id", "text", words_of(F.col("text")).alias("words"))
    base = base.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("rid"), "words",
                       F.size("words").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("hw"))
    n = F.col("n_words")
    parts = [_hashes(F.col("hw"), n, k) for k in sizes]
    rows = base.select("doc_id", "rid", "words", "n_words", F.posexplode_outer(
        F.concat(F.array(F.lit(None).cast("long")), *parts)).alias("at", "h"))
    # decode the place in the joined arrays: its size and its position
    at, pos, size = F.col("at") - 1, F.lit(-1), F.lit(0)
    before = F.lit(0)
    for k in sizes:
        count = F.greatest(n - (k - 1), F.lit(0))
        inside = (at >= before) & (at < before + count)
        pos, size = F.when(inside, at - before).otherwise(pos), F.when(inside, F.lit(k)).otherwise(size)
        before = before + count
    wanted = tokens.select("h").distinct().withColumn("hit", F.lit(True))
    found = {"pos": pos, "g": F.when(F.col("at") > 0, _run(F.col("words"), pos, size))}
    if tokens.select("h").distinct().count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(wanted), "h", "left").filter("at = 0 or hit").withColumns(found)
    else:
        rows = rows.withColumns(found).drop("words").join(wanted, "h", "left").filter("at = 0 or hit")
    return stored(rows.select("rid", "doc_id", F.col("n_words").cast("long").alias("n_words"), "pos", "g"), "matches")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): rid, doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``window`` consecutive words of a benchmark item (item_id, text), or a whole shorter item. Each
    window is a set of shingles of ``shingle`` words (a shorter window is one shingle). Shingles are ordered by
    their frequency in the documents; as containment needs every shingle, a window's prefix is its rarest
    one. Documents are joined on these prefixes, a window must fit between the document's ends, and the other
    shingles that cover it must stand at their places, compared as text.

    n_hit counts words inside any occurrence; contaminated is n_hit > 0 and 20 * n_hit >= n_words. Null or wordless
    texts have no words; items without words have no window; a null item_id marks words but is not among the items.
    Equal windows of several items count for each. Rows with equal doc_id and text get the same result each; a null
    doc_id is kept. Other columns are not read. An empty benchmark hits nothing.
    """
    windows, tokens = _windows(benchmark, window, shingle)
    matches = _matches(docs, tokens, shingle)
    hits = matches.filter("pos >= 0").select("rid", F.col("n_words").cast("int").alias("n_words"), "pos", "g").distinct()
    rarity = hits.groupBy("g").agg(F.count(F.lit(1)).alias("freq"))
    prefix = (tokens.join(rarity, "g").groupBy("w", "len", "size").agg(
        F.count(F.lit(1)).alias("present"), F.min(F.struct("freq", "off", "g")).alias("p"))
        .filter("present = len - size + 1").select("w", "len", "size", F.col("p.off").alias("off"), F.col("p.g").alias("g")))
    candidates = hits.join(prefix, "g").withColumn("start", F.col("pos") - F.col("off")).filter(
        "start >= 0 and start + len <= n_words").select("rid", "start", "w", "len", "size")
    cover = tokens.filter("off % size = 0 or off = len - size").select("w", F.col("off"), "g")
    need = F.ceil(F.col("len") / F.col("size"))
    placed = candidates.join(cover, "w").select("rid", "start", "w", "len", need.alias("need"),
                                                (F.col("start") + F.col("off")).alias("pos"), "g")
    seen = stored(placed.join(hits.select("rid", "pos", "g"), ["rid", "pos", "g"])
                  .groupBy("rid", "start", "w", "len", "need").agg(F.count(F.lit(1)).alias("n"))
                  .filter("n = need").select("rid", "start", "w", "len"), "occurrences")
    end = F.col("start") + F.col("len")
    covered = F.max(end).over(Window.partitionBy("rid").orderBy("start", "len")
                              .rowsBetween(Window.unboundedPreceding, -1))
    n_hit = (seen.select("rid", "start", "len").distinct()
             .withColumn("fresh", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(covered, F.lit(0)))))
             .groupBy("rid").agg(F.sum("fresh").alias("n_hit")))
    items = (seen.select("rid", "w").distinct().join(windows.filter("item_id is not null"), "w")
             .groupBy("rid").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    whole = matches.filter("pos < 0").select("rid", "doc_id", "n_words").join(n_hit, "rid", "left").join(items, "rid", "left")
    hit, ids = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return whole.select("rid", "doc_id", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
                        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    bad = contamination(docs, benchmark).filter("contaminated").select(F.col("rid").alias("__bad")).distinct()
    return docs.join(bad, row_key(docs["doc_id"], docs["text"]) == F.col("__bad"), "left_anti")
