"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A benchmark item is cut into windows, the sets to look for; a window's elements
are its shingles with their places.  A document holds a window only if it holds
all its elements, so one prefix element, the rarest in the corpus, is enough to
find every candidate:

1. documents' shingles are joined with the distinct shingles of all windows
   (one pass over the texts; only matches go on);
2. the matches give each shingle's count over all documents, and each window its
   rarest shingle as prefix;
3. matches of prefixes are candidates, kept within the length and positional
   bounds: the window must begin and end inside the document;
4. a candidate is verified against the document's matches in the whole window.

The shingle table grows with the benchmark, not with the corpus.  It is
broadcast where its measured size is below a bound; a larger one is dealt into
blocks below that bound, with one pass over the documents for each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelprism.llm.common import cut, keys

__all__ = ["decontaminate", "word_array"]

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words, after A-Z are lower-cased: ASCII but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3
#: Bytes of shingles that are broadcast at once.
BROADCAST_BYTES = 16 << 20


def word_array(text: Column) -> Column:
    """Words of a text; none of a null."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), LETTERS, LETTERS.lower())
    return F.array_remove(F.split(lower, GAP), "")


def shingled(words: Column, size: int) -> Column:
    """Array of structs ``w0 .. w<size-1>``: the word at each place and those after it, null beyond the end."""
    parts = [words if k == 0 else F.slice(words, k + 1, F.greatest(F.size(words) - k, F.lit(0))) for k in range(size)]
    return F.arrays_zip(*(p.alias(f"w{k}") for k, p in enumerate(parts)))


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """``item_id, n, size, grams``: every window of every item, as the texts of its shingles in order."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), word_array(F.col("text")).alias("words")).distinct()
    items = items.select("item_id", "words", F.least(F.size("words"), F.lit(window)).alias("n")).where("n > 0")
    starts = items.select("item_id", "words", "n", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)).alias("start"))
    inside = starts.select("item_id", "n", F.least(F.col("n"), F.lit(SHINGLE)).alias("size"), F.slice("words", F.col("start"), F.col("n")).alias("words"))
    gram = F.transform(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1),
                       lambda k: F.array_join(F.slice("words", k, F.col("size")), " "))
    return inside.select("item_id", "n", "size", gram.alias("grams")).distinct()


def blocks_of(grams: DataFrame, most: int) -> list[DataFrame]:
    """The shingle table in blocks of about ``most`` bytes, each small enough to broadcast."""
    size = grams.agg(F.sum(F.octet_length("gram") + 64)).head()[0] or 0
    n = 1 + size // most
    return [grams.where(F.pmod(F.xxhash64("gram"), F.lit(n)) == k) for k in range(n)]


def document_matches(docs: DataFrame, grams: DataFrame, size: int) -> DataFrame:
    """One row per document (``pos`` 0 or null) and one per place whose shingle of ``size`` words is in ``grams``."""
    words = [f"w{k}" for k in range(size)]
    places = docs.select("doc_id", "id", "tag", F.size("words").alias("n_words"), F.posexplode_outer(shingled(F.col("words"), size)).alias("pos", "w"))
    places = places.select("doc_id", "id", "tag", "n_words", "pos", *(F.col(f"w.{w}").alias(w) for w in words), F.xxhash64(*(F.col(f"w.{w}") for w in words)).alias("h"))
    parts = F.split("gram", " ")
    table = grams.select("gram", *(parts[k].alias(f"g{k}") for k in range(size)), F.xxhash64(*(parts[k] for k in range(size))).alias("gh"))
    equal = reduce(lambda a, b: a & b, (F.col(w) == F.col(f"g{k}") for k, w in enumerate(words)), F.col("h") == F.col("gh"))
    found = places.join(F.broadcast(table), equal, "left")
    return found.where("gram is not null or pos = 0 or pos is null").select("doc_id", "id", "tag", "n_words", "pos", F.lit(size).alias("size"), "gram")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``doc_id, id, tag, n_words, n_hit, items array<string>, n_items, contaminated`` of every row of ``docs``.

    Windows are ``window`` consecutive words of an item, or all words of a
    shorter one.  ``n_hit`` counts the document's words inside any occurrence of
    a window, ``items`` lists the items with occurring windows, sorted as
    strings.  Null and empty texts have no words and no hits; null item ids are
    not listed; repeated items count once; repeated documents get equal rows;
    other columns are ignored; an empty benchmark hits nothing.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(k) for k, c in keys().items()), word_array(F.col("text")).alias("words"))

    windows = cut(item_windows(benchmark, window))
    grams = cut(windows.select("size", F.explode("grams").alias("gram")).distinct())
    sizes = sorted({SHINGLE, *(r[0] for r in windows.select("size").distinct().collect())})  # 1 to SHINGLE
    passes = []
    for size in sizes:
        for k, block in enumerate(blocks_of(grams.where(F.col("size") == size), broadcast_bytes)):
            found = document_matches(source, block, size)
            whole = size == SHINGLE and k == 0  # the pass that also has every document
            passes.append((found if whole else found.where("gram is not null")).withColumn("whole", F.lit(whole)))
    found = cut(reduce(DataFrame.unionByName, passes))

    everyone = found.where(F.col("whole") & F.coalesce(F.col("pos") == 0, F.lit(True))).select("doc_id", "id", "tag", "n_words")
    matches = found.where("gram is not null").select("id", "tag", "n_words", "size", "pos", "gram").distinct()

    count = matches.groupBy("gram").agg(F.count(F.lit(1)).alias("times"))
    distinct = windows.select("n", "size", "grams").distinct()
    # windows with a shingle that no document has drop out with the inner join's lost row
    elements = distinct.select("n", "size", "grams", F.posexplode("grams").alias("offset", "gram")).join(count, "gram")
    prefix = (elements.groupBy("n", "size", "grams").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("times", "gram", "offset")).alias("p"))
              .where(F.col("found") == F.size("grams")).select("n", "size", "grams", F.col("p.gram").alias("gram"), F.col("p.offset").alias("offset")))

    candidates = (matches.join(prefix, ["gram", "size"]).withColumn("start", F.col("pos") - F.col("offset"))
                  .where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words")))
                  .select("id", "tag", "size", "start", "n", "grams").distinct())
    ahead = Window.partitionBy("id", "tag", "size").orderBy("pos").rangeBetween(0, window - 1)
    runs = matches.select("id", "tag", "size", F.col("pos").alias("start"), F.collect_list(F.struct("pos", "gram")).over(ahead).alias("run"))
    here = F.filter("run", lambda x: x.pos <= F.col("start") + F.col("n") - F.col("size"))
    hits = candidates.join(runs, ["id", "tag", "size", "start"]).where(F.transform(here, lambda x: x.gram) == F.col("grams"))

    # words covered by sorted intervals: each adds what lies beyond the furthest end so far
    nothing = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("total"))
    covered = F.aggregate(F.sort_array(F.collect_set(F.struct("start", "end"))), nothing,
                          lambda a, x: F.struct(F.greatest(a.reach, x.end).alias("reach"),
                                                (a.total + F.greatest(x.end - F.greatest(a.reach, x.start), F.lit(0))).alias("total")), lambda a: a.total)
    words_hit = hits.select("id", "tag", "start", (F.col("start") + F.col("n")).alias("end")).groupBy("id", "tag").agg(covered.cast("long").alias("n_hit"))
    items = (hits.select("id", "tag", "n", "grams").distinct().join(windows.select("n", "grams", "item_id"), ["n", "grams"])
             .groupBy("id", "tag").agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    out = everyone.join(words_hit.join(items, ["id", "tag"]), ["id", "tag"], "left")
    return out.select("doc_id", "id", "tag", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items")).withColumns(
        {"n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0})
