"""Benchmark passages in documents, by winnowed fingerprints and extension of their hits.

A fingerprint is the smallest hash among each `window - gram + 1` consecutive grams of words. Two texts
that share `window` words in a row share all grams of that stretch, so also its smallest hash: no such
stretch can be missed. A document's fingerprints that some item shares are extended to the windows around
them, and the words of these windows are compared with those of the items' windows. Items meet documents
by their distinct windows, never place by place, so repeated words cost no more than others.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurevote.llm.common import text_key, written

WINDOW = 10
GRAM = 4
# A fingerprint has the place of its gram in its low bits and the gram's hash above.
PLACE_BITS = 28
# Fixed value: a word is a run of ASCII letters and digits and of everything beyond ASCII.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words with A-Z in lower case; no words for a missing text."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )
    return F.coalesce(F.array_remove(F.split(low, BETWEEN_WORDS), ""), F.array().cast("array<string>"))


def fingerprints(rows: DataFrame, spans: list[int], gram: int) -> DataFrame:
    """The rows once for each fingerprint, with the columns `span`, `hash` and `place` (of its first
    word, from 0) in place of the array `words`. `spans` are the lengths of windows; a row with fewer
    words than a window has no fingerprint of that length. Windows shorter than `gram` are one gram."""
    others = [c for c in rows.columns if c != "words"]
    none = F.array().cast("array<long>")
    hashed = rows.select(*others, F.transform("words", lambda w: F.xxhash64(w)).alias("_h"))

    def grams(size: int) -> Column:
        def packed(i: Column) -> Column:
            of_gram = F.xxhash64(*[F.get("_h", i + j) for j in range(size)])
            return F.shiftleft(of_gram, PLACE_BITS).bitwiseOR(i.cast("long"))

        every = F.transform(F.sequence(F.lit(0), F.size("_h") - size), packed)
        return F.when(F.size("_h") >= size, every).otherwise(none).alias(f"_g{size}")

    def picked(span: int) -> Column:
        size = min(gram, span)
        width = span - size + 1
        every = F.col(f"_g{size}")
        starts = F.sequence(F.lit(1), F.size(every) - width + 1)
        lowest = F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(every, i, width))))
        found = F.when(F.size(every) >= width, lowest).otherwise(none)
        return F.transform(found, lambda f: F.struct(F.lit(span).alias("span"), f.alias("f")))

    made = hashed.select(*others, *[grams(size) for size in sorted({min(gram, s) for s in spans})])
    found = made.select(*others, F.explode(F.concat(*[picked(s) for s in spans])).alias("_f"))
    return found.select(
        *others,
        F.col("_f.span").alias("span"),
        F.shiftrightunsigned("_f.f", PLACE_BITS).alias("hash"),
        F.col("_f.f").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int").alias("place"),
    )


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, n_words, n_hit, items, spans, contaminated) of every document.

    A document word is hit if it lies in an occurrence of a window, `window` consecutive words of an
    item; an item with fewer words, but not none, is one window. `items` holds the ids of items with
    occurring windows, sorted as strings, `spans` the (first, last) words of the longest stretches of
    hit words. Missing and empty texts have no words, on both sides. Repeated document ids get one row
    each, told apart by their text; repeated item ids count once; an item without an id can hit but is
    not listed. Other columns are left behind. Empty tables give no rows, or no hits.

    Texts of documents are read where they lie; only those of documents that share a fingerprint with
    an item, and narrow rows, are exchanged. What belongs to the benchmark is written first, so that
    Spark knows its size when it chooses how to join.
    """
    items = benchmark.select(
        F.col(item_id_col).cast("string").alias("item"), words_of(F.col(item_text_col)).alias("words")
    ).where(F.size("words") > 0)
    items = items.withColumn("own", F.least(F.size("words"), F.lit(window))).distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text_key(text).alias("key"), text.alias("text"))
    counted = keyed.select("id", "key", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    listed, stretches = "array<string>", "array<struct<first:int,last:int>>"
    # At most `window` different values.
    spans = sorted(r["own"] for r in items.select("own").distinct().collect())
    if not spans:
        return counted.select(
            F.col("id").alias(id_col),
            "n_words",
            F.lit(0).cast("long").alias("n_hit"),
            F.array().cast(listed).alias("items"),
            F.array().cast(stretches).alias("spans"),
            F.lit(False).alias("contaminated"),
        )

    of_items = fingerprints(items.select("own", "words"), spans, gram).where("span = own")
    of_items = written(of_items.select("span", "hash").distinct())
    starts = F.sequence(F.lit(0), F.size("words") - F.col("own"))
    each = F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, F.col("own"))))
    windows = written(items.select("item", each.alias("window")).distinct())

    of_docs = fingerprints(keyed.select("id", "key", words_of(F.col("text")).alias("words")), spans, gram)
    shared = of_docs.join(of_items, ["span", "hash"])
    shared = written(shared.groupBy("id", "key").agg(F.collect_set(F.struct("span", "place")).alias("shared")))

    def same(other: DataFrame, to: DataFrame) -> Column:
        return to["id"].eqNullSafe(other["_id"]) & (to["key"] == other["_key"])

    def renamed(df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({"id": "_id", "key": "_key"})

    # A repeated row is looked at once; the last join finds all its copies again.
    marked = renamed(shared)
    near = keyed.join(marked, same(marked, keyed)).drop("_id", "_key").dropDuplicates(["id", "key"])
    near = near.select("id", "key", "shared", words_of(F.col("text")).alias("words"))

    def around(span: int) -> Column:
        """Windows of this length that hold a shared fingerprint's gram."""
        back = span - min(gram, span)
        of_span = F.filter("shared", lambda s: s["span"] == span)
        firsts = F.transform(
            of_span,
            lambda s: F.sequence(F.greatest(F.lit(0), s["place"] - back), F.least(s["place"], F.size("words") - span)),
        )
        return F.transform(
            F.array_distinct(F.flatten(firsts)),
            lambda i: F.struct(i.alias("first"), F.slice("words", i + 1, span).alias("window")),
        )

    around_all = near.select("id", "key", F.explode(F.concat(*[around(s) for s in spans])).alias("_w"))
    around_all = around_all.select("id", "key", "_w.first", "_w.window")
    found = written(around_all.join(windows.select("window").distinct(), "window"))

    last = (F.col("first") + F.size("window") - 1).alias("last")
    places = found.select("id", "key", F.struct("first", last).alias("place"), F.lit(None).cast("string").alias("item"))
    named = found.select("id", "key", "window").distinct().join(windows.where("item IS NOT NULL"), "window")
    named = named.select("id", "key", F.lit(None).cast(places.schema["place"].dataType).alias("place"), "item")
    hits = places.union(named).groupBy("id", "key")
    hits = hits.agg(F.collect_set("place").alias("places"), F.array_sort(F.collect_set("item")).alias("items"))

    hit_words = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["first"], p["last"]))))
    hits = hits.select("id", "key", "items", hit_words.alias("hit"))
    # A stretch begins where the word before is not hit, and ends where the next one is not.
    begins = F.array_sort(F.array_except("hit", F.transform("hit", lambda w: w + 1)))
    ends = F.array_sort(F.array_except("hit", F.transform("hit", lambda w: w - 1)))
    stretch = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("first"), b.alias("last")))
    hits = written(hits.select("id", "key", "items", F.size("hit").cast("long").alias("n_hit"), stretch.alias("spans")))

    hits = renamed(hits)
    return counted.join(hits, same(hits, counted), "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast(listed)).alias("items"),
        F.coalesce("spans", F.array().cast(stretches)).alias("spans"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
