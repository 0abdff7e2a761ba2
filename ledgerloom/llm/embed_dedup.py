"""Exact near-duplicates of embeddings by a metric range join.

On unit vectors a cosine of c is a distance of sqrt(2 - 2c).  Pivots divide the
vectors of a label into cells by nearest pivot.  By the triangle inequality a
partner of x can lie in another pivot's cell only if x is at most twice the
range farther from that pivot than from its own, and, as the space is
Euclidean, only if x is within the range of the plane between the two; there x
is replicated.  Cells then join independently.  A large cell is a grid of
blocks of bounded size, joined block by block.

A block pair sends no pairs: it returns how many links each vector has, and for
each vector the least member of its component within the block pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import connected_components
from ledgerloom.plans import materialize

#: Vectors that a pivot stands for in a label, until there are as many pivots as the
#: square root of them; and bytes of all pivots, which are collected, at most.
PER_PIVOT, PIVOT_BYTES = 4096, 64 << 20
#: Vectors of a side of a block pair, about.
BLOCK = 2048


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _assign(pivots: dict[tuple, np.ndarray], reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, dims = batch.column("label").to_pylist(), batch.column("dim").to_pylist()
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(labels, dims)):
                groups.setdefault(key, []).append(i)
            rows, cells, home = [], [], []
            for key, at in groups.items():
                marks = pivots.get(key)
                if marks is None or len(marks) < 2:
                    rows += at
                    cells += [0] * len(at)
                    home += [True] * len(at)
                    continue
                x = _unit(_matrix(batch.column("embedding").take(pa.array(at))))
                d2 = np.maximum(2 - 2 * x @ marks.T, 0)
                own = d2.argmin(axis=1)
                least = d2[np.arange(len(x)), own]
                apart = np.sqrt(np.maximum(2 - 2 * marks @ marks.T, 1e-30))
                near = np.sqrt(d2) <= np.sqrt(least)[:, None] + 2 * reach
                near &= (d2 - least[:, None]) <= 2 * reach * apart[own]
                near[np.arange(len(x)), own] = True
                i, j = np.nonzero(near)
                rows += [at[k] for k in i]
                cells += j.tolist()
                home += (own[i] == j).tolist()
            part = batch.select(["node", "copies", "label", "dim", "embedding"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.int32()), pa.array(home, pa.bool_())], [*part.schema.names, "cell", "home"])

    return run


def _least_labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least index each of ``n`` nodes can reach over undirected edges."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            return label


def _join_block(least_cosine: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        role = np.asarray(table.column("role").combine_chunks().to_numpy(zero_copy_only=False)).astype(bool)
        node = table.column("node").to_numpy()
        copies = table.column("copies").to_numpy()
        vectors = _unit(_matrix(table.column("embedding")))
        home, other = np.flatnonzero(role), np.flatnonzero(~role)
        links = np.zeros(len(node), np.int64)
        lefts, rights = [], []
        for lo in range(0, len(home), 512):
            mine = home[lo : lo + 512]
            i, j = np.nonzero(vectors[mine] @ vectors[other].T >= least_cosine)
            a, b = mine[i], other[j]
            apart = node[a] != node[b]
            a, b = a[apart], b[apart]
            np.add.at(links, a, copies[b])
            lefts.append(a)
            rights.append(b)
        # A node may be on both sides; its first row stands for it.
        first = np.searchsorted(node, node)
        left = first[np.concatenate(lefts)] if lefts else np.empty(0, int)
        right = first[np.concatenate(rights)] if rights else np.empty(0, int)
        label = _least_labels(len(node), left, right)[first]
        keep = (links > 0) | (label != first)
        return pa.table({"node": node[keep], "links": links[keep], "root": node[label[keep]]})

    return run


def near_duplicate_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least_cosine: float = 0.93
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row.

    Rows link when their labels are equal and not null, their vectors have one
    length and the cosine in double precision is ``least_cosine`` or more.
    Vectors that are null, empty or zero, or hold null or non-finite
    components, link with nothing, and neither do rows with a null id.
    ``component_id`` is the least id reachable (the row's own without links),
    ``kept`` says that it is the row's own.  Equal vectors of a label are one
    node and link with each other, so groups of copies cost nothing; rows that
    repeat an id count each for itself, whatever their labels.  An empty table
    gives an empty table.

    A label of up to BLOCK vectors is one cell.  A larger one has two pivots and
    more: one for PER_PIVOT vectors, later as many as the root of its size, with
    PIVOT_BYTES for all labels; the number changes the work, not the result.
    Cells that are large all the same are joined in more blocks.  In high
    dimensions, where distances hardly differ, most vectors are replicated to
    most cells of their label, and the work grows with the square of the label's
    size.
    """
    base = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite
        & F.exists("embedding", lambda x: x != 0), F.lit(False),
    )
    nodes = materialize(
        base.where(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
        .withColumns({"dim": F.size("embedding"), "node": F.monotonically_increasing_id()}),
        "nodes",
    )
    reach = float(np.sqrt(max(2 - 2 * least_cosine, 0))) + 1e-9
    wanted = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).withColumn(
        "want", F.greatest(F.lit(2.0), F.least(F.sqrt("n"), F.col("n") / PER_PIVOT))
    )
    # A hash chooses about as many as wanted; some more of few, so that there are two.
    wanted = materialize(wanted.withColumn("want", F.col("want") + 2 * F.sqrt("want")), "wanted")
    size = wanted.agg(F.sum(F.col("want") * F.col("dim") * 8)).first()[0] or 0
    share = F.col("want") * min(1.0, PIVOT_BYTES / max(size, 1)) / F.col("n")
    drawn = F.xxhash64("node", F.lit("pivot")).bitwiseAND((1 << 62) - 1) / float(1 << 62)
    chosen = nodes.join(wanted, ["label", "dim"]).where(drawn < share)
    found: dict[tuple, list] = {}
    for r in chosen.select("label", "dim", "embedding").collect():
        found.setdefault((r[0], r[1]), []).append(r[2])
    pivots = {k: _unit(np.array(v, dtype=np.float64)) for k, v in found.items()}
    kinds = dict(nodes.dtypes)
    columns = ", ".join(f"{c} {kinds[c]}" for c in ("node", "copies", "label", "dim", "embedding"))
    placed = materialize(nodes.mapInArrow(_assign(pivots, reach), f"{columns}, cell int, home boolean"), "placed")
    cell = ["label", "dim", "cell"]
    sizes = placed.groupBy(cell).agg(
        F.ceil(F.count_if("home") / BLOCK).cast("int").alias("n_home"), F.ceil(F.count("*") / BLOCK).cast("int").alias("n_other")
    )
    dealt = placed.join(sizes, cell).where("n_home > 0")
    mine, theirs = (F.pmod(F.xxhash64("node", F.lit(s)), F.col(c)).cast("int") for s, c in (("a", "n_home"), ("b", "n_other")))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    keep = [*cell, "node", "copies", "embedding"]
    sent = dealt.where("home").select(*keep, mine.alias("b"), F.explode(upto("n_other")).alias("c"), F.lit(True).alias("role")).unionAll(
        dealt.select(*keep, F.explode(upto("n_home")).alias("b"), theirs.alias("c"), F.lit(False).alias("role"))
    )
    blocks = sent.groupBy(*cell, "b", "c").applyInArrow(_join_block(least_cosine), "node bigint, links bigint, root bigint")
    blocks = materialize(blocks, "blocks")
    roots = connected_components(blocks, "node", "root")
    counts = blocks.groupBy("node").agg(F.sum("links").alias("links"))
    joined = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    known = (
        joined.join(named, "root").join(counts, "node", "left")
        .select("label", "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    )
    linked = base.where(usable).join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = base.where(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
