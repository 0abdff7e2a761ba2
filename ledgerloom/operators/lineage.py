"""Standing and named queries over lines of development.

The tables are relational ledgers of any number of logs:

``candidates``  log_id, id, time, basis, parent, anchor (its Selection or null)
``selections``  log_id, id, time, objective, candidate (chosen), tainted, replaces
``derived``     log_id, src, dst: a candidate and one it is derived from
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.graph import closure, descents


def restorations(selections: DataFrame) -> DataFrame:
    """``log_id``, ``id`` and ``by``: unsound selections and the sound ones that replace them.

    A sound selection restores all ancestors of its chain of replacements.
    """
    back = selections.where("replaces is not null").select("log_id", F.col("id").alias("src"), F.col("replaces").alias("dst"), F.lit("replace").alias("via"), F.lit(0).alias("ordinal"))
    sound = selections.where(~F.col("unsound")).select("log_id", F.col("id").alias("start"))
    chain = descents(sound.join(back.select("log_id", F.col("src").alias("start")), ["log_id", "start"], "left_semi"), back)
    unsound = selections.where("unsound").select("log_id", F.col("id").alias("node"))
    return chain.join(unsound, ["log_id", "node"]).select("log_id", F.col("node").alias("id"), F.col("start").alias("by"))


def compromised(candidates: DataFrame, selections: DataFrame, derived: DataFrame, restored: DataFrame, retracted: DataFrame) -> DataFrame:
    """Candidates whose standing is compromised, as ``log_id`` and ``id``.

    Seeds are retracted candidates and continuations of an unsound selection
    that no sound one restores with their parent among the chosen; from there
    it spreads to children and derivations.  Soundness is a conjunction over
    what a candidate stands on, so the least closure is the answer.
    ``restored`` has ``log_id``, ``id`` (selection) and ``candidate`` (chosen by
    the restoring one).
    """
    anchored = candidates.where("anchor is not null").select("log_id", "id", "anchor", "parent")
    bad = anchored.join(selections.where("unsound").select("log_id", F.col("id").alias("anchor")), ["log_id", "anchor"])
    saved = restored.select("log_id", F.col("id").alias("anchor"), F.col("candidate").alias("parent"))
    bad = bad.join(saved, ["log_id", "anchor", "parent"], "left_anti").select("log_id", F.col("id").alias("node"))
    seeds = bad.unionAll(retracted.select("log_id", F.col("id").alias("node")))
    forward = candidates.where("parent is not null").select("log_id", F.col("parent").alias("src"), F.col("id").alias("dst"))
    forward = forward.unionAll(derived.select("log_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return closure(seeds, forward).select("log_id", F.col("node").alias("id"))


def frontier(candidates: DataFrame, selections: DataFrame) -> DataFrame:
    """``log_id``, ``id`` and ``state`` of candidates that nothing follows.

    ``unconsidered``: no selection has considered it.  ``selected-no-continuation``:
    chosen, but no continuation starts from it.  ``selections`` has a row a
    considered candidate, with ``chosen``.
    """
    seen = selections.groupBy("log_id", F.col("candidate").alias("id")).agg(F.max("chosen").alias("chosen"))
    followed = candidates.where("anchor is not null").select("log_id", F.col("parent").alias("id"), F.lit(True).alias("followed")).distinct()
    state = F.when(F.col("chosen").isNull(), "unconsidered").when(F.col("chosen") & F.col("followed").isNull(), "selected-no-continuation")
    return (
        candidates.select("log_id", "id").join(seen, ["log_id", "id"], "left").join(followed, ["log_id", "id"], "left")
        .select("log_id", "id", state.alias("state")).where("state is not null")
    )


def siblings(candidates: DataFrame, causes: DataFrame) -> DataFrame:
    """``log_id``, ``id`` and ``sibling``: same basis and the same set of causes; roots have none.

    ``causes`` has ``log_id``, ``src`` and ``dst``.  The set is compared as a
    whole, sorted.  A pair stands in both directions.
    """
    sets = causes.groupBy("log_id", F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("set"))
    keyed = candidates.where("basis <> 'Root'").select("log_id", "id", "basis").join(sets, ["log_id", "id"])
    other = keyed.select("log_id", "basis", "set", F.col("id").alias("sibling"))
    return keyed.join(other, ["log_id", "basis", "set"]).where("id <> sibling").select("log_id", "id", "sibling")


def selected(selections: DataFrame, objective: str) -> DataFrame:
    """Selections under exactly this objective, with what they chose, in log order."""
    return selections.where((F.col("objective") == objective) & F.col("chosen")).select("log_id", "time", "id", "candidate", "unsound")


def back_edges(candidates: DataFrame, derived: DataFrame) -> DataFrame:
    """Edges of descent: anchors, then the parent of a continuation; sources of a derivation, ascending."""
    anchor = candidates.where("anchor is not null").select("log_id", F.col("id").alias("src"), F.col("anchor").alias("dst"), F.lit("continuation-anchor").alias("via"), F.lit(0).alias("ordinal"))
    parent = candidates.where("parent is not null").select("log_id", F.col("id").alias("src"), F.col("parent").alias("dst"), F.lit("parent").alias("via"), F.lit(1).alias("ordinal"))
    place = F.row_number().over(Window.partitionBy("log_id", "src").orderBy("dst"))
    from_ = derived.select("log_id", "src", "dst", F.lit("derivation").alias("via"), place.alias("ordinal"))
    return anchor.unionAll(parent).unionAll(from_)


def descent(candidates: DataFrame, derived: DataFrame, starts: DataFrame) -> DataFrame:
    """Everything that the starts descend from, in the order of a queue."""
    return descents(starts, back_edges(candidates, derived))


def descendants(candidates: DataFrame, derived: DataFrame, starts: DataFrame) -> DataFrame:
    """``log_id`` and ``id`` of candidates whose descent holds one of ``starts`` (log_id, node)."""
    forward = back_edges(candidates, derived).select("log_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closure(starts, forward).where("level > 0").select("log_id", F.col("node").alias("id"), "level")
