"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

Suffixes are sorted into buckets only as deep as it takes to tell whether their
first 50 bytes stand in an earlier document too.

1. *Initial buckets by q-gram.*  Of every 50-byte window the least 16-byte gram
   is its anchor; the suffixes that begin at anchors stand for all others.  An
   entry is a run of windows of one anchor with its bucket (the gram), the grams
   next to the anchor and a digest of all bytes that its windows cover.  Within a
   bucket equal digests are equal runs, and all but the first document's are
   repeats.  An entry alone with its neighbouring grams is a singleton bucket
   and done.
2. *Refinement by pointers.*  What is left is refined byte by byte.  Suffixes are
   first put into buckets of depth 25.  Those of buckets with one owner only are
   done; each of the others gets its bucket's pointer back.  Then the pointers
   at p and p + 25 name the bucket of depth 50 at p: depth doubles with every
   round, and a round uses nothing but the pointers that the one before wrote.
   At full depth the bucket's least document owns the string.

Texts are read in shards.  A shard keeps its suffixes, groups them by itself and
sends one entry a bucket and group, so that a passage which a third of all
documents share costs one entry a shard; pointers come back to the shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.llm import packs, spans
from ledgerloom.llm.packs import groups, heads
from ledgerloom.llm.spans import NONE, U
from ledgerloom.llm.tokens import batch_segments, gathered, grams, text_bytes
from ledgerloom.plans import materialize

GRAM = 16
#: Stands for a null id.
NO_ID = -(1 << 63)
#: Entries of one anchor that a batch sends; beyond, all are refined by pointers.
CROWD = 64
#: Runs of windows in a shard.
SHARD = 1 << 14
#: A run of windows as one number: start, one bit for "to be refined", windows.
_RUN = "doc_id bigint, sum bigint, run bigint"
#: What shards send to buckets and buckets to shards: entries (kind 0), and a shard's own suffixes (kind 1).
_MAIL = "bucket int, shard bigint, kind int, payload binary"
_LOW40, _LOW48 = U((1 << 40) - 1), U((1 << 48) - 1)


def text_sum(text: Column) -> Column:
    """40 bits of a hash, which tell texts of one id apart."""
    return F.xxhash64(text).bitwiseAND((1 << 40) - 1)


def _rows(ids: np.ndarray, sums: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
    """Runs in order, which packs better."""
    order = np.lexsort((run, sums, ids))
    ids, sums, run = ids[order], sums[order], run[order]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids.astype(np.int64)), pa.array(sums.astype(np.int64)), pa.array(run.astype(np.int64))], ["doc_id", "sum", "run"]
    )


def _run(start: np.ndarray, count: np.ndarray, refine: bool = False) -> np.ndarray:
    return (start.astype(np.int64) << 8) + count.astype(np.int64) + (128 if refine else 0)


def _numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)


def _entries(length: int, buckets: int, crowd_size: int):
    """Entries by bucket; runs that are settled already go in buckets from ``buckets`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sums = _numbers(batch)
            s = batch_segments(batch.column(2), length, GRAM, "bytes")
            if not len(s.doc):
                continue
            order = np.lexsort((ids[s.doc], s.digest, s.anchor))
            owner = ids[s.doc[order]]
            gone = owner > owner[heads(groups(s.anchor[order], s.digest[order]))]
            done = [(s.doc[order[gone]], _run(s.start[order[gone]], s.count[order[gone]]))]
            order = order[~gone]
            # A crowd at one anchor is refined by pointers; a few stand for it.
            rank = np.arange(len(order)) - heads(groups(s.anchor[order]))
            wait = rank >= crowd_size
            crowd = np.isin(s.anchor, s.anchor[order[wait]])
            done.append((s.doc[order[wait]], _run(s.start[order[wait]], s.count[order[wait]], True)))
            stay = np.sort(order[~wait])
            s, crowd = s.take(stay), crowd[stay]
            small = s.count.astype(U) | (s.place.astype(U) << U(6)) | (s.tied.astype(U) << U(12)) | (crowd.astype(U) << U(13))
            small |= (s.left.astype(U) << U(16)) | (s.right.astype(U) << U(28))
            body = [(s.anchor >> U(6)) & _LOW40, s.digest & _LOW48, small, sums[s.doc], ids[s.doc], s.start]
            yield packs.dealt((spans.mixed(s.anchor) % U(buckets)).astype(np.int64), body, 4)
            doc, runs = (np.concatenate(x) for x in zip(*done))
            order = np.lexsort((runs, doc))
            doc, runs = doc[order], runs[order]
            if len(doc):
                yield packs.dealt(buckets + doc % buckets, [ids[doc], sums[doc], runs], 0)

    return run


def _shared(new: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether an entry's group has more than one owner."""
    if not len(new):
        return np.empty(0, bool)
    at = np.flatnonzero(new)
    return (np.minimum.reduceat(owner, at) < np.maximum.reduceat(owner, at))[np.cumsum(new) - 1]


def _refine(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, columns in packs.by_bucket(batches):
            if b >= buckets:
                yield _rows(*columns)
                continue
            anchor, digest, small, sums, ids, start = columns
            order = np.lexsort((ids, digest, anchor))
            ids, sums, anchor, digest, small, start = (x[order] for x in (ids, sums, anchor, digest, small, start))
            new = groups(anchor)
            marks = np.bitwise_or.reduceat((small >> 12) & 3, np.flatnonzero(new))[np.cumsum(new) - 1]
            gone = ids > ids[heads(groups(anchor, digest))]
            yield _rows(ids[gone], sums[gone], _run(start[gone], small[gone] & 63))
            ids, sums, anchor, small, start, marks = (x[~gone] for x in (ids, sums, anchor, small, start, marks))
            count, place = small & 63, (small >> 6) & 63
            new = groups(anchor)
            # Those of a crowd that wait may be another document's.
            whole = (marks > 1) | (((marks > 0) | (length < 3 * GRAM - 1)) & _shared(new, ids))
            alike = []
            for side in ((small >> 16) & 0xFFF, (small >> 28) & 0xFFF):
                order = np.lexsort((ids, side, anchor))
                found = np.empty(len(ids), bool)
                found[order] = _shared(groups(anchor[order], side[order]), ids[order]) & (side[order] != NONE)
                alike.append(found | whole)
            # A shared window holds the anchor, and the gram before it or the one after (a
            # shorter window may hold neither): with only one alike, it starts on that side.
            low = np.where(alike[0], 0, np.maximum(place - GRAM + 1, 0))
            high = np.where(alike[1], count, np.minimum(place - (length - 2 * GRAM) + 1, count))
            ask = (alike[0] | alike[1]) & (low < high)
            yield _rows(ids[ask], sums[ask], _run(start[ask] + low[ask], (high - low)[ask], True))

    return run


def depths(length: int) -> list[int]:
    """Depths of the rounds: halves of ``length``, rounded up, while they hold a gram."""
    out = [length]
    while -(-out[0] // 2) > GRAM:
        out.insert(0, -(-out[0] // 2))
    return out


def _offsets(rounds: list[int]) -> list[int]:
    """Places in a window whose buckets of the first depth make up its full depth."""
    out = [0]
    for low, high in zip(reversed(rounds[:-1]), reversed(rounds[1:])):
        out = sorted({o + d for o in out for d in (0, high - low)})
    return out


def _mail(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in _MAIL.split(", ")])


def _sent(ids: np.ndarray, sums: np.ndarray, row: np.ndarray, at: np.ndarray, keys: list[np.ndarray], shard: int, buckets: int) -> pa.RecordBatch:
    """A shard's groups of equal keys, one entry each by bucket, and its suffixes.

    An entry has the keys, the group's number, and its least and greatest id.
    """
    order = np.lexsort((ids[row], *keys))
    new = groups(*(k[order] for k in keys))
    begin = np.flatnonzero(new)
    owner = ids[row[order]]
    low, span = owner[begin], np.maximum.reduceat(owner, begin) - owner[begin]
    # Groups are numbered in order of their first suffix, which packs well.
    first = np.minimum.reduceat(order, begin)
    by_first = np.argsort(first)
    number = np.empty(len(begin), np.int64)
    number[by_first] = np.arange(len(begin))
    group = np.empty(len(row), np.int64)
    group[order] = number[np.cumsum(new) - 1]
    keys, low, span = [k[order][begin][by_first] for k in keys], low[by_first], span[by_first]
    mixed = keys[0].astype(U)
    for k in keys[1:]:
        mixed = spans.joined(mixed, k.astype(U))
    bucket = ((spans.mixed(mixed) >> U(20)) % U(buckets)).astype(np.int64)
    sent = packs.dealt(bucket, [*(k.view(np.int64) for k in keys), span, np.arange(len(low)), low], len(keys) + 1)
    used, index = np.unique(row, return_inverse=True)
    head = packs.pack([ids[used], sums[used]], 0)
    own = np.array([len(head)], "<i8").tobytes() + head + packs.pack([index, at, group], 0)
    rows = [(b, shard, 0, p) for b, p in zip(sent.column(0).to_pylist(), sent.column(1).to_pylist())]
    return _mail([*rows, (shard % buckets, shard, 1, own)])


def _shards(length: int, buckets: int):
    """Asked windows as suffixes with their grams of the first depth."""
    rounds = depths(length)
    offsets = _offsets(rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sums = _numbers(batch)
            data, bounds = text_bytes(batch.column(2))
            runs = batch.column(3)
            asked = np.asarray(runs.flatten()).astype(np.int64)
            row = np.repeat(np.arange(len(ids)), np.asarray(runs.value_lengths()))
            order = np.lexsort((asked, row))
            starts, counts, row = asked[order] >> 8, asked[order] & 127, row[order]
            for lo in range(0, len(row), SHARD):
                r, s, c = row[lo : lo + SHARD], starts[lo : lo + SHARD], counts[lo : lo + SHARD]
                begin = bounds[r] + s
                part, upto = gathered(data, begin, begin + c + length - 1)
                window = np.repeat(upto[:-1] - (np.cumsum(c) - c), c) + np.arange(c.sum())
                at = np.unique(np.concatenate([window + o for o in offsets]))
                piece = np.searchsorted(upto, at, side="right") - 1
                hashes = spans.window_hashes(grams(part, GRAM, "bytes"), at, GRAM, rounds[0])
                doc, where = r[piece], at - upto[piece] + s[piece]
                # Runs may share suffixes.
                key, keep = np.unique(doc.astype(np.int64) << 40 | where, return_index=True)
                doc, where, hashes = key >> 40, key & int(_LOW40), hashes[keep]
                told = [ids[doc], sums[doc], where]
                shard = xxhash.xxh64_intdigest(b"".join(np.ascontiguousarray(x).tobytes() for x in told)) >> 1
                yield _sent(ids, sums, doc, where, [hashes], shard, buckets)

    return run


def _resolved(keys: int, last: bool):
    """Buckets answer every shard: pointers, or the least owner at full depth.

    Only groups with several owners get an answer; the others are singletons.
    """

    def answers(bucket: int, mail: list[tuple[int, bytes]]) -> pa.RecordBatch | None:
        parts = [packs.unpack(p) for _, p in mail]
        columns = [np.concatenate(x) for x in zip(*parts)]
        names, (span, number, low) = columns[:keys], columns[keys:]
        sender = np.repeat(np.arange(len(mail)), [len(p[0]) for p in parts])
        order = np.lexsort(names)
        new = groups(*(k[order] for k in names))
        begin = np.flatnonzero(new)
        least = np.minimum.reduceat(low[order], begin)
        live = least < np.maximum.reduceat((low + span)[order], begin)
        value = least if last else np.cumsum(live)
        which = np.cumsum(new) - 1
        told = np.empty(len(order), np.int64)
        told[order] = value[which]
        alive = np.empty(len(order), bool)
        alive[order] = live[which]
        cuts = np.searchsorted(sender, np.arange(len(mail) + 1))
        rows = []
        for i, (shard, _) in enumerate(mail):
            mine = np.flatnonzero(alive[cuts[i] : cuts[i + 1]]) + cuts[i]
            if len(mine):
                rows.append((bucket, shard, 0, packs.pack([told[mine], number[mine]], 1)))
        return _mail(rows) if rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            own = batch.filter(pa.compute.equal(batch.column(2), 1))
            if own.num_rows:
                yield own
            for b, shard, kind, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if kind:
                    continue
                if b != now and held:
                    if (out := answers(now, held)) is not None:
                        yield out
                    held = []
                now = b
                held.append((shard, payload))
        if held and (out := answers(now, held)) is not None:
            yield out

    return run


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each shard's suffixes (ids, sums, row, place, group) with its answers (bucket, value, group)."""

    def opened(shard: int, own: bytes, told: list[tuple[int, bytes]]) -> tuple:
        size = int(np.frombuffer(own, "<i8", 1)[0])
        parts = [(b, *packs.unpack(p)) for b, p in told]
        bucket = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
        value, number = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        return shard, *packs.unpack(own[8 : 8 + size]), *packs.unpack(own[8 + size :]), bucket, value, number

    now, own, told = None, None, []
    for batch in batches:
        for b, shard, kind, payload in zip(*(c.to_pylist() for c in batch.columns)):
            if shard != now:
                if own is not None and told:
                    yield opened(now, own, told)
                now, own, told = shard, None, []
            if kind:
                own = payload
            else:
                told.append((b, payload))
    if own is not None and told:
        yield opened(now, own, told)


def _doubled(step: int, buckets: int):
    """Suffixes of the next depth: those with a pointer at p and at p + step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, ids, sums, row, at, group, bucket, value, number in _by_shard(batches):
            pointer = np.zeros(int(group.max()) + 1, np.int64)
            pointer[number] = bucket.astype(np.int64) << 34 | value  # values begin at 1
            mine = pointer[group]
            key = row << 40 | at
            other = np.searchsorted(key, key + step)
            other[other == len(key)] = 0
            both = (mine > 0) & (key[other] == key + step) & (mine[other] > 0)
            if both.any():
                yield _sent(ids, sums, row[both], at[both], [mine[both], mine[other[both]]], shard, buckets)

    return run


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that an earlier document owns, as runs."""
    for _, ids, sums, row, at, group, _, value, number in _by_shard(batches):
        owner = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
        owner[number] = value
        gone = ids[row] > owner[group]
        row, at = row[gone], at[gone]
        if len(row):
            key = row << 40 | at
            begin = np.flatnonzero(np.diff(key, prepend=-2) != 1)
            count = np.diff(np.append(begin, len(key)))
            # A run counts 64 windows at most.
            times = -(-count // 64)
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            begin, count = np.repeat(begin, times) + 64 * part, np.minimum(np.repeat(count, times) - 64 * part, 64)
            yield _rows(ids[row[begin]], sums[row[begin]], _run(at[begin], count))


def with_key(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``sum`` and ``text``, the first two never null, and the columns ``keep``.

    Without nulls Spark adds no filter under a join, so that joins of one query
    with the texts share an exchange.  A null id becomes the least bigint; such
    rows neither lose nor remove anything.
    """
    return docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc_id"),
        text_sum(F.col(text_col)).alias("sum"),
        F.col(text_col).cast("string").alias("text"),
        *keep,
    )


def repeated_runs(docs: DataFrame, length: int = 50) -> DataFrame:
    """Runs of windows that also start in a document of smaller id.

    ``docs`` comes from :func:`with_key`.  Returns ``doc_id``, ``sum`` and
    ``run``: the byte offset of the first window times 256, plus their number.
    Each step is written before the next begins, so that what one has shuffled
    is off the disk by then.
    """
    if not GRAM < length < GRAM + 64:
        raise ValueError(f"length must be from {GRAM + 1} to {GRAM + 63}")
    parts = buckets = packs.parts_for(docs)
    known = docs.where((F.col("doc_id") != NO_ID) & F.col("text").isNotNull())
    entries = packs.exchanged(known.mapInArrow(_entries(length, buckets, CROWD), packs.PACKED), parts)
    first = materialize(entries.mapInArrow(_refine(length, buckets), _RUN), "runs")
    refine = F.col("run").bitwiseAND(128) > 0
    return first.where(~refine).unionAll(materialize(refined(docs, first.where(refine), length), "refined"))


def refined(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """The windows of ``runs`` that also start, in ``runs``, in a smaller id.

    Rounds of pointer refinement: a shard's suffixes go to buckets, pointers
    come back, and the next depth's keys are pairs of them.
    """
    parts = buckets = packs.parts_for(docs)
    asked = runs.groupBy("doc_id", "sum").agg(F.collect_list("run").alias("runs"))
    texts = docs.join(asked, ["doc_id", "sum"]).select("doc_id", "sum", "text", "runs")
    mail = texts.mapInArrow(_shards(length, buckets), _MAIL)
    rounds = depths(length)
    for i, depth in enumerate(rounds):
        last = depth == length
        told = packs.exchanged(mail, parts).mapInArrow(_resolved(1 if i == 0 else 2, last), _MAIL)
        back = told.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard")
        mail = back.mapInArrow(_owned, _RUN) if last else back.mapInArrow(_doubled(rounds[i + 1] - depth, buckets), _MAIL)
    return mail


def keep_mask(size: int, starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Which of ``size`` tokens no window of the runs covers."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, starts + counts + length - 1, 1)
    return np.cumsum(edge[:size]) == 0


def _cut(length: int, as_text: bool):
    """Results of (id, sum, text, runs, further columns), which stay last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(2))
            runs = batch.column(3)
            lengths = np.asarray(runs.value_lengths().fill_null(0))
            flat = np.asarray(runs.flatten()).astype(np.int64)
            starts, counts = flat >> 8, flat & 127
            upto = np.concatenate([[0], np.cumsum(lengths)])
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept")}
            spans_out = []
            for i in range(batch.num_rows):
                text = data[bounds[i] : bounds[i + 1]]
                mine = slice(upto[i], upto[i + 1])
                keep = keep_mask(len(text), starts[mine], counts[mine], length) if lengths[i] else np.ones(len(text), bool)
                turns = np.diff(np.concatenate([[1], keep, [1]]).astype(np.int8))
                begin, end = np.flatnonzero(turns == -1), np.flatnonzero(turns == 1)
                out["n_bytes"].append(len(text))
                out["n_removed"].append(int(len(text) - keep.sum()))
                out["n_spans"].append(len(begin))
                if as_text and len(begin):  # every part by itself, or halves of two characters might make a third
                    edges = np.concatenate([[0], np.stack([begin, end], axis=1).ravel(), [len(text)]]).reshape(-1, 2)
                    out["kept"].append("".join(text[a:b].tobytes().decode("utf-8", "ignore") for a, b in edges.tolist()).encode())
                else:
                    out["kept"].append(text[keep].tobytes())
                spans_out.append([{"start": a, "end": b} for a, b in zip(begin.tolist(), end.tolist())])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")),
                    pa.array(spans_out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(out["kept"], pa.binary()).view(pa.string() if as_text else pa.binary()),
                    *batch.columns[4:],
                ],
                ["doc_id", "sum", "n_bytes", "n_removed", "n_spans", "spans", "kept", *batch.schema.names[4:]],
            )

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, as_text: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Each document without the bytes of strings that start in an earlier one.

    A byte goes if a string of ``length`` bytes that covers it also starts in a
    document with a smaller id; strings are judged on the input and never cross
    documents.  Returns a row for every row: ``doc_id``, ``sum``, ``n_bytes``,
    ``n_removed``, ``n_spans``, ``spans`` (removed runs, byte offsets) and
    ``kept`` (bytes; a cut may split a character, and ``as_text`` leaves the halves
    out and gives a string).  The columns ``keep`` follow; their names are not among
    those, nor ``text`` or ``runs``.  Null and empty texts have no
    bytes.  Rows of one id don't remove each other's bytes, and rows alike in
    id and text get the same result.  A row with a null id is kept whole and
    removes nothing.  Ids are integers.  An empty table gives an empty table.

    Two different strings are taken for equal only if their identifiers agree: 88
    bits and the shuffled bucket (8 and more), or two hashes of 64 bits and a
    bucket, one of each half.
    """
    runs = repeated_runs(with_key(docs, id_col, text_col), length).groupBy("doc_id", "sum").agg(F.collect_list("run").alias("runs"))
    base = with_key(docs, id_col, text_col, keep)
    joined = base.join(runs, ["doc_id", "sum"], "left").select("doc_id", "sum", "text", "runs", *keep)
    found = "doc_id bigint, sum bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,end:bigint>>, "
    schema = StructType.fromDDL(found + f"kept {'string' if as_text else 'binary'}")
    for name in keep:
        schema.add(base.schema[name])
    cut = joined.mapInArrow(_cut(length, as_text), schema)
    return cut.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
