"""Value vocabulary and lookup of misspelt names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuelens.functions import text as T
from venuelens.operators.skew import top_k
from venuelens.session import shared_dir


def vocabulary(issue: DataFrame, footfall: DataFrame, itemwise: DataFrame) -> DataFrame:
    """Distinct values of six columns, numbers taken out; a value in two lists stays in both.
    Each table is read once, and its columns become distinct before the shuffle."""
    def lists(df: DataFrame, cols: dict[str, str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value")) for kind, c in cols.items()])
        return (df.select(F.inline(pairs)).filter(F.col("value") != "").distinct()
                .withColumn("value", T.without_numbers(F.col("value"))).distinct())

    return (lists(itemwise, {"dish": "item_name", "menu": "menu_name"})
            .unionByName(lists(issue, {"item": "item_name", "department": "issue_name"}))
            .unionByName(lists(footfall, {"source": "source_of_booking", "status": "booking_status"})))


def kept(df: DataFrame) -> DataFrame:
    """Checkpointed: the vocabulary costs a pass over whole tables, is small, and is used several times."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _rank(pairs: DataFrame, vocab: DataFrame, k: int) -> DataFrame:
    """Exact score of (term, value, shared, tn, vn) pairs, the lists each value is in, and the best ``k``."""
    scored = pairs.select("term", "value", (F.col("shared") / (F.col("tn") + F.col("vn") - F.col("shared"))).alias("jaccard"),
                          F.levenshtein(F.lower("term"), F.lower("value")).alias("distance"))
    return top_k(scored.join(vocab, "value"), ["term"],
                 [F.col("jaccard").desc(), F.col("distance"), F.col("value"), F.col("kind")], k)


def _compared(pairs: DataFrame) -> DataFrame:
    """Sizes and overlap of the trigram lists of (term, tg, value, vg) pairs."""
    return pairs.select("term", "value", F.size(F.array_intersect("tg", "vg")).alias("shared"),
                        F.size("tg").alias("tn"), F.size("vg").alias("vn"))


def value_lookup(terms: DataFrame, vocab: DataFrame, k: int = 8, hot_values: int = 1000) -> DataFrame:
    """The ``k`` vocabulary rows spelt most like each term, among those sharing a trigram.

    Candidates come from trigrams that fewer than ``hot_values`` values have. A value that shares
    only hot trigrams scores at most (hot trigrams of the term) / (its trigrams), so a term whose
    ``k``-th result beats that bound is done; the others are looked up again with all trigrams, the
    hot ones spread by salt. The result is the same as without the shortcut."""
    vocab = kept(vocab)
    t = (terms.select("term").filter(F.col("term").isNotNull()).distinct()
         .withColumn("tg", T.trigrams(F.col("term"))))
    v = vocab.select("value").distinct().withColumn("vg", T.trigrams(F.col("value")))
    t_index, v_index = T.each(t, F.col("tg"), "gram"), T.each(v, F.col("vg"), "gram")
    hot = v_index.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_values)
    if hot.isEmpty():
        # every shared trigram gives one joined row, so their count is the overlap
        counted = (t_index.select("term", F.size("tg").alias("tn"), "gram")
                   .join(v_index.select("value", F.size("vg").alias("vn"), "gram"), "gram")
                   .groupBy("term", "value", "tn", "vn").agg(F.count(F.lit(1)).alias("shared")))
        return _rank(counted, vocab, k)

    hot = hot.select("gram", F.ceil(F.col("n") / hot_values).cast("int").alias("salts"))
    rare = (t_index.join(hot, "gram", "left_anti").join(v_index, "gram")
            .select("term", "tg", "value", "vg").distinct())
    first = _rank(_compared(rare), vocab, k)
    bound = (t_index.join(hot.select("gram"), "gram", "left_semi").groupBy("term", "tg")
             .agg((F.count(F.lit(1)) / F.first(F.size("tg"))).alias("bound")))
    kth = first.filter(F.col("rank") == k).select("term", F.col("jaccard").alias("kth"))
    open_terms = (bound.join(kth, "term", "left")
                  .filter(F.col("kth").isNull() | (F.col("kth") <= F.col("bound"))).select("term"))
    t_hot = (t_index.join(open_terms, "term", "left_semi").join(hot, "gram")
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))))
    v_hot = v_index.join(hot, "gram").withColumn(
        "salt", F.pmod(F.xxhash64("value"), F.col("salts")).cast("int"))
    by_hot = t_hot.join(v_hot.drop("salts"), ["gram", "salt"]).select("term", "tg", "value", "vg")
    again = rare.join(open_terms, "term", "left_semi").unionByName(by_hot).distinct()
    return first.join(open_terms, "term", "left_anti").unionByName(_rank(_compared(again), vocab, k).select(*first.columns))


PREFIX = 3  # rarest trigrams of a term that its first candidates must share one of


def _by_rarity(index: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """(key, all, known, gram, pos): the trigrams of each key that some value has, rarest first, numbered from 0; ``all``
    counts its trigrams, ``known`` those listed."""
    found = index.join(counts, "gram").groupBy(key, "all").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("g"))
    return T.each(found.withColumn("known", F.size("g")), F.col("g"), "x", "pos").select(
        key, "all", "known", F.col("x.gram").alias("gram"), "pos")


def value_lookup_join(terms: DataFrame, vocab: DataFrame, k: int = 8, hot_values: int = 1000) -> DataFrame:
    """The rows of ``value_lookup`` by a prefix-filtered top-k set join.

    Trigrams of both sides are ordered by rarity. A term first meets the values that share one of its PREFIX rarest
    trigrams; the ``k``-th score among them is its threshold, which only rises from there. A value met first at place i
    of the term and j of itself shares at most min(known - i, n - j) trigrams, so only places at which that can still reach
    the threshold are joined, whatever the length of the value. A trigram that many values have is met there by few
    terms, and is spread by salt. Null and repeated terms are left out; an empty side gives no rows."""
    vocab = kept(vocab)
    t = (terms.select("term").filter(F.col("term").isNotNull()).distinct().withColumn("tg", T.trigrams(F.col("term"))))
    v = vocab.select("value").distinct().withColumn("vg", T.trigrams(F.col("value")))
    v_index = T.each(v, F.col("vg"), "gram").select("value", F.size("vg").alias("all"), "gram")
    counts = v_index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    salts = counts.select("gram", F.ceil(F.col("n") / hot_values).cast("int").alias("salts"))
    t_index = _by_rarity(T.each(t, F.col("tg"), "gram").select("term", F.size("tg").alias("all"), "gram"), counts, "term")
    salt = F.pmod(F.xxhash64("value"), F.col("salts")).cast("int")
    values = (_by_rarity(v_index, counts, "value").join(salts, "gram").select(
        "value", "gram", F.col("all").alias("n"), F.col("pos").alias("j"), salt.alias("salt")))

    def met(side: DataFrame) -> DataFrame:
        return (side.join(salts, "gram").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
                .drop("salts").join(values, ["gram", "salt"]))

    def overlaps(pairs: DataFrame) -> DataFrame:
        return _compared(pairs.select("term", "value").distinct().join(t, "term").join(v, "value"))

    first = kept(overlaps(met(t_index.filter(F.col("pos") < PREFIX))))
    reached = _rank(first, vocab, k).filter(F.col("rank") == k).select("term", F.col("jaccard").alias("least"))
    most = F.least(F.col("known") - F.col("pos"), F.col("n") - F.col("j"))
    can = lambda size: F.col("known") - F.col("pos") >= F.coalesce("least", F.lit(0.0)) * size - 1e-9
    rest = t_index.filter(F.col("pos") >= PREFIX).join(reached, "term", "left").filter(can(F.col("all")))
    later = met(rest).filter(most >= F.coalesce("least", F.lit(0.0)) * (F.col("all") + F.col("n") - most) - 1e-9)
    return _rank(first.unionByName(overlaps(later.join(first, ["term", "value"], "left_anti"))), vocab, k)
