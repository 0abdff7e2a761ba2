"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact check.

1. Shingle hashes of every text are looked up in the benchmark's.  A window as
   similar to an item as asked shares most of its shingles with it, so only
   starts with that many hits in reach are windows at all; nothing that could
   pass is left out.
2. Every such window of an item's size gets a SimHash fingerprint.  Five blocks
   of its 64 bits index it: two fingerprints within 19 bits differ by at most 3
   in one of the blocks, and the items' blocks are indexed with all values within
   3 bits.  So an equi-join on blocks finds all items within the radius, and of
   unlike fingerprints less than a quarter meet.
3. The weighted (multiset) Jaccard similarity of shingles decides.

Everything is DataFrame and SQL functions.  Windows of equal content, as in a
passage that many documents share, are judged once, and arrays are fetched only
for pairs within the radius.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans import materialize

SHINGLE = 5
#: Least similarity, and bits by which fingerprints may differ: at a similarity of
#: 0.8, 9.7 of 64 bits differ on average, and over 19 with a probability of 0.001.
SIMILARITY, RADIUS = 0.8, 19
#: Blocks of a fingerprint, and bits by which one of them differs at most.
BLOCKS = 5
NEAR = RADIUS // BLOCKS
#: Distinct benchmark shingles that are looked up as constants; more are joined.
CONSTANTS = 50_000
#: Rows of the items' index that are broadcast; more are shuffled.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Words between ASCII white space, A-Z lower-cased; none for null."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.array().cast("array<string>"))


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however the optimizer moves it."""
    return F.get(F.transform(F.array(value), use), 0)


def gram_hashes(word_hashes: Column, k: int) -> Column:
    """Hash of every run of ``k`` words; none for fewer words."""

    def each(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))
        return F.when(F.size(w) >= k, runs).otherwise(F.array().cast("array<bigint>"))

    return held(word_hashes, each)


def simhash(hashes: Column) -> Column:
    """64 bits, each set when set in over half of the hashes.

    Four bits are counted at a time, in 16-bit lanes of one number; of more than
    65,535 hashes two, in 32-bit lanes.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def lanes(w: Column, r: int, width: int) -> Column:
        ones = sum(1 << at for at in range(0, 64, width))
        total = F.aggregate(w, none, lambda a, x: a + F.shiftrightunsigned(x, r).bitwiseAND(F.lit(ones)))
        set_bits = lambda t: [
            F.when(F.shiftrightunsigned(t, at).bitwiseAND(F.lit((1 << width) - 1)) * 2 > F.size(w), F.shiftleft(one, r + at)).otherwise(none)
            for at in range(0, 64, width)
        ]
        return held(total, lambda t: reduce(lambda a, b: a.bitwiseOR(b), set_bits(t)))

    def bits(w: Column, width: int) -> Column:
        return reduce(lambda a, b: a.bitwiseOR(b), [lanes(w, r, width) for r in range(width)])

    return held(hashes, lambda w: F.when(F.size(w) <= 0xFFFF, bits(w, 16)).otherwise(bits(w, 32)))


def _widths() -> list[int]:
    return [64 // BLOCKS + (b < 64 % BLOCKS) for b in range(BLOCKS)]


def fingerprint_blocks(fingerprint: Column, near: int = 0) -> Column:
    """The blocks of a fingerprint as (block, value), each with all values within ``near`` bits."""

    def block(b: int, at: int, width: int) -> Column:
        value = F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        masks = F.array(*(F.lit(sum(1 << i for i in c)) for k in range(near + 1) for c in combinations(range(width), k)))
        return F.transform(masks, lambda m: F.struct(F.lit(b).alias("block"), value.bitwiseXOR(m).alias("value")))

    widths = _widths()
    return F.concat(*(block(b, sum(widths[:b]), width) for b, width in enumerate(widths)))


def shared_weight(left: Column, right: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    return F.aggregate(
        F.array_intersect(left, right), F.lit(0), lambda a, x: a + F.least(count(left, x), count(right, x))
    )


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``item_id``, ``similarity``, ``start`` and ``n_words`` of each leak.

    A document leaks an item if one of its windows of the item's length (the
    whole document if that is shorter) has a weighted Jaccard similarity of
    five-word shingles of 0.8 or more with it; ``start`` is the first word of
    the most similar window, the first of several.  An item of fewer than five
    words is one shingle and must stand in the document as it is.  Items and
    documents without words, or null, match nothing.  Items alike in text are
    all reported, repeated rows of a document once, rows with a null id under
    null.  Clean documents have no row.
    """
    items = (
        benchmark.select(F.col(item_col).alias("item_id"), F.transform(words(F.col(item_text_col)), lambda w: F.xxhash64(w)).alias("w"))
        .where("size(w) > 0")
        .withColumn("k", F.least(F.size("w"), F.lit(SHINGLE)))
    )
    sizes = sorted(r[0] for r in items.select("k").distinct().collect())  # five numbers at most
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("sum"),
        F.transform(words(F.col(text_col).cast("string")), lambda w: F.xxhash64(w)).alias("w"),
    )
    if not sizes:
        kinds = dict(base.dtypes) | dict(items.dtypes)
        return docs.sparkSession.createDataFrame(
            [], f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, similarity double, start int, n_words int"
        )
    return reduce(DataFrame.unionAll, (_of_size(base, items.where(F.col("k") == k), k) for k in sizes))


def _of_size(base: DataFrame, items: DataFrame, k: int) -> DataFrame:
    grams = gram_hashes(F.col("w"), k).alias("grams")
    items = materialize(items.select("item_id", F.monotonically_increasing_id().alias("item"), grams).withColumn("m", F.size("grams")), "items")
    shingles = items.select(F.explode("grams").alias("h")).distinct()
    known = [r[0] for r in shingles.limit(CONSTANTS + 1).collect()]
    texts = base.select("doc_id", "sum", gram_hashes(F.col("w"), k).alias("grams"))
    if len(known) <= CONSTANTS:
        placed = F.transform("grams", lambda h, i: F.struct(i.alias("at"), h.alias("h")))
        hit = texts.withColumn("hits", F.transform(F.filter(placed, lambda p: p["h"].isin(known)), lambda p: p["at"])).where("size(hits) > 0")
    else:
        spread = texts.select("doc_id", "sum", F.posexplode("grams").alias("at", "h"))
        found = spread.join(shingles, "h", "left_semi").groupBy("doc_id", "sum").agg(F.sort_array(F.collect_set("at")).alias("hits"))
        hit = texts.alias("t").join(found.alias("f"), F.expr("t.doc_id <=> f.doc_id and t.sum = f.sum")).select("t.doc_id", "t.sum", "grams", "hits")
    hit = materialize(hit.dropDuplicates(["doc_id", "sum"]), "hits")
    index = items.select("item", "m", F.explode(F.array_distinct("grams")).alias("h"))
    small = index.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda d: d)
    near = (
        hit.select("doc_id", "sum", F.size("grams").alias("d"), F.explode("hits").alias("at"), F.get("grams", F.col("at")).alias("h"))
        .join(hint(index), "h")
        .groupBy("doc_id", "sum", "item", "m", "d")
        .agg(F.sort_array(F.collect_list("at")).alias("p"))
    )
    # A window of m shingles needs so many in common; the places p[i] .. p[i + need - 1] must fit.
    near = near.withColumn("size", F.least("m", "d")).withColumn(
        "need", F.greatest(F.lit(1), F.ceil(SIMILARITY / (1 + SIMILARITY) * (F.col("m") + F.col("size")) - 1e-9).cast("int"))
    )
    # Their ends only grow, so each begins behind the one before: no start comes twice.
    top = lambda i: F.least(F.get("p", i), F.col("d") - F.col("size"))
    spans = F.transform(
        F.sequence(F.lit(0), F.size("p") - F.col("need")),
        lambda i: F.struct(
            F.greatest(
                F.lit(0), F.get("p", i + F.col("need") - 1) - F.col("size") + 1, F.when(i > 0, top(i - 1) + 1).otherwise(F.lit(0))
            ).alias("low"),
            top(i).alias("high"),
        ),
    )
    runs = near.where("size(p) >= need").select("doc_id", "sum", "m", "size", F.explode(F.filter(spans, lambda s: s["low"] <= s["high"])).alias("run"))
    asked = runs.select("doc_id", "sum", "m", "size", F.explode(F.sequence("run.low", "run.high")).alias("start")).distinct()
    same = F.expr("a.doc_id <=> h.doc_id and a.sum = h.sum")
    window = F.slice("grams", F.col("start") + 1, F.col("size"))
    windows = materialize(
        asked.alias("a").join(hit.alias("h"), same).select("a.doc_id", "a.sum", "m", "size", "start", F.xxhash64(window).alias("content")), "windows"
    )
    one = windows.groupBy("m", "content").agg(F.min(F.struct("doc_id", "sum", "start", "size")).alias("one")).select("m", "content", "one.*")
    alike = materialize(
        one.alias("a").join(hit.alias("h"), same).select("m", "content", window.alias("window")).withColumn("mark", simhash(F.col("window"))), "alike"
    )
    index = items.withColumn("mark", simhash(F.col("grams"))).select(
        "item", "m", F.col("mark").alias("item_mark"), F.inline(fingerprint_blocks(F.col("mark"), NEAR))
    )
    met = (
        alike.select("m", "content", "mark", F.inline(fingerprint_blocks(F.col("mark"))))
        .join(index, ["m", "block", "value"])
        .where(F.bit_count(F.col("mark").bitwiseXOR(F.col("item_mark"))) <= RADIUS)
        .select("m", "content", "item").distinct()
    )
    both = shared_weight(F.col("window"), F.col("grams"))
    close = (
        met.join(alike.select("m", "content", "window"), ["m", "content"]).join(items.select("item", "item_id", "grams"), "item")
        .withColumn("both", both)
        .select("m", "content", "item_id", (F.col("both") / (F.size("window") + F.size("grams") - F.col("both"))).alias("similarity"))
        .where(F.col("similarity") >= SIMILARITY)
    )
    best = F.max_by(F.struct("similarity", "start", "m"), F.struct(F.col("similarity"), -F.col("start")))
    return (
        windows.select("doc_id", "sum", "m", "start", "content").join(close, ["m", "content"])
        .groupBy("doc_id", "sum", "item_id").agg(best.alias("b"))
        .select("doc_id", "item_id", "b.similarity", "b.start", (F.col("b.m") + k - 1).alias("n_words"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that leak an item; columns unchanged.

    A row goes if any row of its id leaks; rows with a null id all stay unless
    such a row leaks.
    """
    bad = contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("_leaks")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_leaks"]), "left_anti")
