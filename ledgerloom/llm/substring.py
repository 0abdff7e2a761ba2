"""Removal of repeated word spans by compacting a De Bruijn graph.

The graph is built in minimizer space.  A node is a 16-word k-mer that is least
among the k-mers of some 50-word window; an edge leads along the words of all
consecutive windows with that least k-mer and is named by a hash of them.  So a
document is a walk over edges, and there is one edge for about 18 words.

1. Edges are counted with a grouped minimum of their places; the least place is
   an edge's source.
2. Where a repeated edge has one successor only, which has it as only predecessor
   and stands right behind it in the source document, a join of the edges with
   themselves links the two.  Chains of links are the compacted paths: an
   interval of the source document each.
3. A later document's walk along a path, in step with the source, is one span:
   candidate and source coordinates.  Only spans on compacted paths are ever
   removed, so without paths nothing is.
4. Where a node has different edges in different documents, a passage may begin
   or end within an edge; there the windows are compared one by one, and runs of
   them in step with a source are spans too.
5. Every span's words are compared with its source's: a 128-bit digest of them is
   taken at both coordinates, and only equal ones are cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import packs, spans
from ledgerloom.llm.spans import U
from ledgerloom.llm.tokens import batch_segments, gathered, grams, read
from ledgerloom.llm.suffix import NO_ID, keep_mask, with_key
from ledgerloom.plans import materialize, release

K = 16
#: Digests that one copy of a text is asked for; more share out over further copies.
ASKS = 4096
_SPAN = "doc_id bigint, sum bigint, start bigint, count bigint, source_id bigint, source_sum bigint, source_start bigint"


def _edges(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch_segments(batch.column(2), length, K, "words")
            name = s.digest.view(np.int64)
            follows = np.zeros(len(name), bool)
            follows[1:] = (s.doc[1:] == s.doc[:-1]) & (s.start[1:] == s.start[:-1] + s.count[:-1])
            before = np.concatenate([[0], name[:-1]]) if len(name) else name
            after = np.concatenate([name[1:], [0]]) if len(name) else name
            has_after = np.concatenate([follows[1:], [False]]) if len(name) else follows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(s.doc)), batch.column(1).take(pa.array(s.doc)),
                    pa.array(s.start.astype(np.int32)), pa.array(s.count.astype(np.int32)),
                    pa.array(s.anchor.view(np.int64)), pa.array(name),
                    pa.array(before, mask=~follows), pa.array(after, mask=~has_after),
                ],
                ["doc_id", "sum", "start", "count", "node", "edge", "prev", "next"],
            )

    return run


def compacted(repeated: DataFrame) -> DataFrame:
    """``node``, ``edge``, its ``source`` and ``path``, the source word its path begins at.

    ``repeated`` has edges with ``source`` (document, sum, start), ``count`` and
    the least and greatest neighbours ``p0``, ``p1``, ``n0``, ``n1``.  A path's
    edges stand one behind another in the source document.
    """
    ahead = repeated.where("n0 = n1").select(
        F.col("edge").alias("a"), F.col("n0").alias("b"), "source.doc_id", "source.sum", (F.col("source.start") + F.col("count")).alias("at")
    )
    back = repeated.where("p0 = p1").select(
        F.col("p0").alias("a"), F.col("edge").alias("b"), "source.doc_id", "source.sum", F.col("source.start").alias("at"), "node"
    )
    linked = ahead.join(back, ["a", "b", "doc_id", "sum", "at"]).select("node", F.col("b").alias("edge"), F.lit(True).alias("linked")).distinct()
    # Along the source document a path begins wherever an edge is not linked to the one before.
    along = Window.partitionBy("source.doc_id", "source.sum").orderBy("source.start")
    begin = F.when(F.col("linked").isNull(), F.col("source.start"))
    return repeated.join(linked, ["node", "edge"], "left").select("node", "edge", "source", F.last(begin, ignorenulls=True).over(along).alias("path"))


def _windows(length: int, buckets: int):
    """Windows of asked runs, by hash.

    Within a batch the least document's are sent on; the others repeat it and
    are done, which buckets from ``buckets`` on carry.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sums = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, bounds = read(batch.column(2), "words")
            asked = batch.column(3)
            row = np.repeat(np.arange(len(ids)), np.asarray(asked.value_lengths()))
            starts, counts = (np.asarray(asked.flatten().field(i)).astype(np.int64) for i in (0, 1))
            order = np.lexsort((starts, row))
            starts, counts, row = starts[order], counts[order], row[order]
            for lo in range(0, len(row), 1 << 14):
                r, s, c = row[lo : lo + (1 << 14)], starts[lo : lo + (1 << 14)], counts[lo : lo + (1 << 14)]
                begin = bounds[r] + s
                part, offsets = gathered(data, begin, begin + c + length - 1)
                at = np.repeat(offsets[:-1] - (np.cumsum(c) - c), c) + np.arange(c.sum())
                h = spans.window_hashes(grams(part, K, "words"), at, K, length)
                doc, where = np.repeat(r, c), at - np.repeat(offsets[:-1], c) + np.repeat(s, c)
                order = np.lexsort((where, sums[doc], ids[doc], h))
                h, doc, where = h[order], doc[order], where[order]
                head = packs.heads(packs.groups(h))
                gone = ids[doc] > ids[doc[head]]
                g, f = np.flatnonzero(gone), head[gone]
                rest = np.flatnonzero(~gone)
                rest = rest[np.lexsort((where[rest], doc[rest]))]
                h, bucket = h[rest], ((h[rest] >> U(40)) % U(buckets)).astype(np.int64)
                yield packs.dealt(bucket, [h.view(np.int64), sums[doc[rest]], ids[doc[rest]], where[rest]], 1)
                if len(g):
                    g, f = (x[np.lexsort((where[g], doc[g]))] for x in (g, f))
                    source = [ids[doc[f]], sums[doc[f]], where[f]]
                    yield packs.dealt(buckets + doc[g] % buckets, [ids[doc[g]], sums[doc[g]], where[g], np.ones(len(g), np.int64), *source], 0)

    return run


def _settle(buckets: int):
    names = [x.split()[0] for x in _SPAN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, columns in packs.by_bucket(batches):
            if b < buckets:
                h, sums, ids, start = columns
                order = np.lexsort((start, sums, ids, h))
                h, sums, ids, start = h[order], sums[order], ids[order], start[order]
                head = packs.heads(packs.groups(h))
                gone = ids > ids[head]
                g, f = np.flatnonzero(gone), head[gone]
                columns = [ids[g], sums[g], start[g], np.ones(len(g), np.int64), ids[f], sums[f], start[f]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return run


def _in_step(pieces: DataFrame, *path: str) -> DataFrame:
    """Spans of touching pieces that lie in step with one source (and on one path)."""
    step = F.col("start") - F.col("source_start")
    keys = ["doc_id", "sum", "source_id", "source_sum", *path]
    joined = F.expr("""
      aggregate(at, cast(array() as array<struct<start:bigint,count:bigint>>), (s, x) ->
        case when size(s) > 0 and element_at(s, -1).start + element_at(s, -1).count >= x.start
             then concat(slice(s, 1, size(s) - 1), array(struct(element_at(s, -1).start as start, greatest(element_at(s, -1).count, x.start + x.count - element_at(s, -1).start) as count)))
             else concat(s, array(x)) end)""")
    first, last = F.get("at", F.lit(0)), F.element_at("at", -1)
    whole = F.array(F.struct(first["start"].alias("start"), F.col("total").alias("count")))
    return (
        pieces.groupBy(*keys, step.alias("step"))
        .agg(F.sort_array(F.collect_list(F.struct("start", "count"))).alias("at"), F.sum("count").alias("total"))
        # Pieces do not overlap; mostly they touch all along.
        .withColumn("x", F.explode(F.when(last["start"] + last["count"] - first["start"] == F.col("total"), whole).otherwise(joined)))
        .select("doc_id", "sum", F.col("x.start").alias("start"), F.col("x.count").alias("count"), "source_id", "source_sum", (F.col("x.start") - F.col("step")).alias("source_start"))
    )


def repeated_spans(docs: DataFrame, length: int = 50) -> DataFrame:
    """Spans of windows that also start in a document of smaller id, as found.

    ``docs`` comes from :func:`ledgerloom.llm.suffix.with_key`.  Returns ``doc_id``, ``sum``, ``start`` (word),
    ``count`` (windows) and the source's ``source_id``, ``source_sum`` and
    ``source_start``.  :func:`confirmed` compares the words.
    """
    known = docs.where((F.col("doc_id") != NO_ID) & F.col("text").isNotNull())
    edges = materialize(
        known.mapInArrow(
            _edges(length),
            "doc_id bigint, sum bigint, start int, count int, node bigint, edge bigint, prev bigint, next bigint",
        ),
        "edges",
    )
    counted = edges.groupBy("node", "edge").agg(
        F.min(F.struct("doc_id", "sum", "start")).alias("source"), F.max("doc_id").alias("last"), F.max("count").alias("count"),
        F.min("next").alias("n0"), F.max("next").alias("n1"), F.min("prev").alias("p0"), F.max("prev").alias("p1"),
    ).withColumn("first", F.col("source.doc_id"))
    branching = counted.groupBy("node").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a < b").select("node", F.lit(True).alias("branching"))
    live = materialize(
        counted.join(branching, "node", "left").where("first < last or branching")
        .withColumn("branching", F.coalesce("branching", F.lit(False))),
        "live",
    )
    paths = compacted(live.where("first < last"))
    named = live.select("node", "edge", "first", "branching").join(paths, ["node", "edge"], "left")
    walks = materialize(
        edges.select("doc_id", "sum", "start", "count", "node", "edge").join(named, ["node", "edge"])
        .where("doc_id > first or branching").drop("node", "edge"),
        "walks",
    )
    release(live)
    release(edges)
    pieces = walks.where("doc_id > first and path is not null").select(
        "doc_id", "sum", F.col("start").cast("bigint").alias("start"), F.col("count").cast("bigint").alias("count"), "path",
        F.col("source.doc_id").alias("source_id"), F.col("source.sum").alias("source_sum"), F.col("source.start").cast("bigint").alias("source_start"),
    )
    asked = walks.where("doc_id = first and branching").groupBy("doc_id", "sum").agg(F.collect_list(F.struct("start", "count")).alias("runs"))
    parts = buckets = packs.parts_for(docs)
    texts = docs.join(asked, ["doc_id", "sum"]).select("doc_id", "sum", "text", "runs")
    single = packs.exchanged(texts.mapInArrow(_windows(length, buckets), packs.PACKED), parts).mapInArrow(_settle(buckets), _SPAN)
    return _in_step(pieces, "path").unionAll(_in_step(single))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        asked = batch.column(3)
        lengths = np.asarray(asked.value_lengths()).tolist()
        starts, sizes = (asked.flatten().field(i).to_pylist() for i in (0, 1))
        found, at = [], 0
        for text, n in zip(batch.column(2).to_pylist(), lengths):
            words = text.encode().split()
            found += [xxhash.xxh3_128_digest(b" ".join(words[a : a + m])) for a, m in zip(starts[at : at + n], sizes[at : at + n])]
            at += n
        row = pa.array(np.repeat(np.arange(batch.num_rows), lengths))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(row), batch.column(1).take(row), asked.flatten().field(0), asked.flatten().field(1), pa.array(found, pa.binary())],
            ["doc_id", "sum", "start", "size", "digest"],
        )


def confirmed(docs: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """The spans whose words are those at the source's coordinates."""
    size = (F.col("count") + (length - 1)).alias("size")
    here, there = F.struct("doc_id", "sum", "start"), F.struct(F.col("source_id").alias("doc_id"), F.col("source_sum").alias("sum"), F.col("source_start").alias("start"))
    asks = found.select(F.explode(F.array(here, there)).alias("x"), size).select("x.doc_id", "x.sum", "x.start", "size").distinct()
    # A source that very many differing spans name is read in as many copies as it takes.
    copies = asks.groupBy("doc_id", "sum").agg((F.count("*") / ASKS).cast("int").alias("more")).where("more > 0")
    part = F.when(F.col("more") > 0, F.pmod(F.xxhash64("start", "size"), F.col("more") + 1)).otherwise(F.lit(0))
    lists = (
        asks.join(copies, ["doc_id", "sum"], "left").groupBy("doc_id", "sum", part.alias("part"))
        .agg(F.collect_list(F.struct("start", "size")).alias("asks")).drop("part")
    )
    digests = materialize(
        docs.join(lists, ["doc_id", "sum"]).select("doc_id", "sum", "text", "asks")
        .mapInArrow(_digests, "doc_id bigint, sum bigint, start bigint, size bigint, digest binary"),
        "digests",
    )
    sources = digests.select(
        F.col("doc_id").alias("source_id"), F.col("sum").alias("source_sum"), F.col("start").alias("source_start"), "size", "digest"
    )
    mine = found.select("*", size).join(digests, ["doc_id", "sum", "start", "size"])
    return mine.join(sources, ["source_id", "source_sum", "source_start", "size", "digest"], "left_semi")


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(3)
            lengths = np.asarray(runs.value_lengths().fill_null(0))
            flat = runs.flatten()
            starts, counts = (np.asarray(flat.field(i)).astype(np.int64) for i in (0, 1))
            upto = np.concatenate([[0], np.cumsum(lengths)])
            words_out, removed, kept = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = text.encode().split() if text else []
                gone = 0
                if lengths[i]:
                    mine = slice(upto[i], upto[i + 1])
                    keep = keep_mask(len(words), starts[mine], counts[mine], length)
                    gone = len(words) - int(keep.sum())
                    left = [words[j] for j in np.flatnonzero(keep)]
                else:
                    left = words
                words_out.append(len(words))
                removed.append(gone)
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(words_out, pa.int64()), pa.array(removed, pa.int64()), runs,
                    pa.array(kept, pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in kept], pa.string()),
                ],
                ["doc_id", "sum", "n_words", "n_removed", "runs", "kept", "kept_sha256"],
            )

    return run


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """Each document without the words of spans that start in an earlier one.

    A word goes if a window of ``length`` consecutive words that covers it also
    starts in a document with a smaller id; windows are judged on the input.
    Words end at ASCII white space and are compared unchanged.  Returns a row
    for every row: ``doc_id``, ``sum``, ``n_words``, ``n_removed``, ``runs``
    (window runs: start word, count, and the source's id and start word),
    ``kept`` (words joined by one space) and ``kept_sha256``.  Null, empty and
    blank texts have no words.  Rows of one id don't remove each other's words;
    rows alike in id and text get the same result.  A row with a null id is kept
    whole and removes nothing.  Ids are integers.  An empty table gives an empty
    table.

    Candidates are found by 64-bit hashes; a span is cut only if a 128-bit
    digest of its words is that of the source's words.
    """
    base = with_key(docs, id_col, text_col)
    found = materialize(repeated_spans(base, length), "spans")
    runs = confirmed(base, found, length).groupBy("doc_id", "sum").agg(F.collect_list(F.struct("start", "count", "source_id", "source_start")).alias("runs"))
    joined = base.join(runs, ["doc_id", "sum"], "left").select("doc_id", "sum", "text", "runs")
    cut = joined.mapInArrow(
        _cut(length),
        "doc_id bigint, sum bigint, n_words bigint, n_removed bigint, "
        "runs array<struct<start:bigint,count:bigint,source_id:bigint,source_start:bigint>>, kept string, kept_sha256 string",
    )
    return cut.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
