"""Mixing sources to target word counts by entropy balancing.

Document rates r minimise sum(r log r - r) with one constraint a source,
sum(size * r) = target, and 0 <= r <= 2.  The dual has one multiplier a source
and rates exp(multiplier * size), cut off at 2.  Newton steps, kept inside a
bracket, solve the dual; each step is one grouped aggregate over cells (source,
size), in which documents share a rate: up to 2,048 words a cell is one size,
beyond that sizes within 1.1 % share the rate of their mean.  Rates become copies by carrying the
rounding error from the largest sizes to the smallest, so that a source misses
its target by about half of its smallest documents.  All of it is SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans import materialize, release

#: No document is taken more often.
MOST = 2
#: Documents of one cell that are ranked together.
RANKED = 256
#: Sizes up to this are cells of their own; larger ones share 64 to the octave.
EXACT = 2048
#: Newton steps at most; the bracket alone gives 15 digits in as many.
STEPS = 60


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float) -> DataFrame:
    """One row a source: ``source_size`` and ``target``.

    Sources in order of code points, null last, take ``weights`` in turn.  The
    targets add up to ``share`` times all sizes, none above twice its source's
    size; what is cut off goes to the others by weight.  Numbering sources and
    finding the level takes one task with a row a source.  ``sizes`` holds
    ``source``, ``size`` and ``n`` (documents); the result is the row of the
    water level at which that holds.
    """
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    ranked = totals.withColumn("w", weight.cast("double"))
    most = F.lit(float(MOST)) * F.col("source_size")
    # Filled in order of size against weight: sources before this one are full.
    fill = Window.orderBy(most / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = F.coalesce(F.sum(most).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - before) / rest
    at = ranked.withColumn("level", level)
    # The first source that is not full sets the level for all after it.
    full = F.col("level") * F.col("w") >= most
    mu = F.first(F.when(~full, F.col("level")), ignorenulls=True).over(
        fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return at.withColumn("target", F.coalesce(F.least(mu * F.col("w"), most), most)).select(
        "source", "source_size", "target"
    )


def _solve(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Multiplier of each source whose target is between nothing and all."""
    scale = cells.groupBy("source").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"))
    lam = materialize(
        targets.join(scale, F.expr("target > 0 and target < 2.0 * source_size") & targets.source.eqNullSafe(scale.source))
        .select(targets.source, "target", "mean", *(F.lit(v).alias(k) for k, v in (("lam", 0.0), ("lo", -4096.0), ("hi", 65536.0)))),
        "dual",
    )
    for _ in range(STEPS):
        x = F.col("x") / F.col("mean")
        rate = F.exp(F.least(F.col("lam") * x, F.lit(700.0)))
        held = F.least(rate, F.lit(float(MOST)))
        sums = (
            cells.alias("c")
            .join(lam.alias("l"), F.expr("c.source <=> l.source"))
            .groupBy("l.source", "target", "mean", "lam", "lo", "hi")
            .agg(
                F.sum(F.col("n") * F.col("x") * held).alias("got"),
                F.sum(F.when(rate < MOST, F.col("n") * F.col("x") * x * rate).otherwise(0.0)).alias("slope"),
            )
        )
        lo = F.when(F.col("got") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("got") > F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") + (F.col("target") - F.col("got")) / F.col("slope")
        done = F.abs(F.col("got") - F.col("target")) <= 1e-9 * F.col("target")
        inside = (F.col("slope") > 0) & (newton > lo) & (newton < hi)
        step = F.when(done, F.col("lam")).when(inside, newton).otherwise((lo + hi) / 2)
        then = materialize(
            sums.select("source", "target", "mean", step.alias("lam"), lo.alias("lo"), hi.alias("hi"), done.alias("done")), "dual"
        )
        release(lam)
        lam = then.drop("done")
        lam._scratch_path = then._scratch_path
        if not then.where("not done").limit(1).count():
            return lam
    raise RuntimeError(f"the dual did not converge in {STEPS} steps")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Copies of every document, so that each source comes to its target.

    Returns one row a document: ``doc_id``, ``source``, ``size`` (words),
    ``source_size``, ``target`` (its source's), ``rate`` (0 to 2), ``copies``
    (0, 1 or 2) and the columns ``keep`` of ``docs``.  A null text has size 0 and a null source is a source of its
    own.  Documents without words are kept once: they weigh nothing.  Repeated
    rows count each for itself.  Which documents of a cell get one copy more is
    settled by a hash of the id, then of the text, so reruns agree; rows alike
    in both are numbered and give the same rows whatever the order.  An empty
    table gives an empty table.

    A window holds at most about 256 documents, or the cells of one source:
    at most 2,048 plus 64 for each doubling of the longest text.
    """
    kept = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("tie"),
            *keep,
        ),
        "sizes",
    )
    step = F.floor(F.log2("size") * 64)
    cell = F.when(F.col("size") <= EXACT, F.col("size")).otherwise(EXACT + step)
    kept = kept.withColumn("cell", cell.cast("long"))
    cells = materialize(
        kept.groupBy("source", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "cells"
    )
    sizes = cells.select("source", (F.col("words").cast("double") / F.col("n")).alias("size"), "n")
    targets = materialize(
        source_targets(sizes, weights, share).withColumn("source_size", F.round("source_size").cast("long")), "targets"
    )
    counted = cells.select("source", "cell", "n", (F.col("words").cast("double") / F.col("n")).alias("x"))
    # Sums in another order differ in the last digits, which rounding takes off.
    lam = _solve(counted.where("x > 0"), targets).select("source", F.round("lam", 10).alias("lam"), "mean")
    full = F.expr("case when target >= 2.0 * source_size then 2.0 when target <= 0 then 0.0 end")
    tilted = F.least(F.exp(F.least(F.col("lam") * F.col("x") / F.col("mean"), F.lit(700.0))), F.lit(float(MOST)))
    rated = (
        counted.alias("c")
        .join(targets.alias("t"), F.expr("c.source <=> t.source"))
        .join(lam.alias("l"), F.expr("c.source <=> l.source"), "left")
        .select("c.source", "cell", "n", "x", "source_size", "target",
                F.when(F.col("x") == 0, 1.0).otherwise(F.coalesce(full, tilted)).alias("rate"))
    )
    # Carry from the largest sizes on: k is a cell's copies, err the words still due.
    folded = rated.groupBy("source", "source_size", "target").agg(
        F.sort_array(F.collect_list(F.struct("x", "cell", "n", "rate")), asc=False).alias("cells")
    )
    fold = """aggregate(cells, struct(cast(0 as double) as err, cast(array() as array<struct<cell:bigint,n:bigint,rate:double,k:bigint>>) as done),
      (s, c) -> with_k(s, c))"""
    k = "cast(case when c.x = 0 then c.n else greatest(0L, least(2L * c.n, round(c.n * c.rate + s.err / c.x))) end as bigint)"
    fold = fold.replace(
        "with_k(s, c)",
        f"struct(s.err + (c.n * c.rate - {k}) * c.x as err, concat(s.done, array(struct(c.cell as cell, c.n as n, c.rate as rate, {k} as k))) as done)",
    )
    copies = folded.select("source", "source_size", "target", F.explode(F.expr(fold)["done"]).alias("filled")).select(
        "source", "source_size", "target", "filled.cell", "filled.n", "filled.rate", "filled.k"
    )
    # A cell's copies go to salted parts of it, in proportion, and there to ranks.
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / RANKED)).cast("long")
    salted = (
        kept.alias("d")
        .join(copies.alias("c"), F.expr("d.source <=> c.source and d.cell = c.cell"))
        .select("doc_id", "d.source", "d.cell", "size", "tie", "source_size", "target", "rate", "n", "k", *keep,
                F.pmod(F.xxhash64("tie", F.lit("part")), parts).alias("part"))
    )
    return _rank(salted, keep)


def _rank(salted: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    salted = materialize(salted, "salted")
    sums = salted.groupBy("source", "cell", "part").agg(F.count("*").alias("m"))
    upto = Window.partitionBy("source", "cell").orderBy("part")
    held = sums.withColumn("upto", F.sum("m").over(upto))
    near = Window.partitionBy("d.source", "d.cell", "d.part").orderBy("tie", "doc_id")
    joined = salted.alias("d").join(
        held.alias("h"), F.expr("d.source <=> h.source and d.cell = h.cell and d.part = h.part")
    )
    # Copies of the parts up to and with this one, less those before it.
    mine = F.floor(F.col("k") * F.col("upto") / F.col("n")) - F.floor(F.col("k") * (F.col("upto") - F.col("m")) / F.col("n"))
    base = F.floor(mine / F.col("m"))
    copies = base + (F.row_number().over(near) <= mine - base * F.col("m")).cast("long")
    return joined.select("doc_id", "d.source", "size", "source_size", "target", "rate", copies.cast("long").alias("copies"), *keep)
