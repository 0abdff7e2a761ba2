"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within 2r bits share a variant within r bits of either.  So
every distinct fingerprint emits its whole ball of half the radius, the
variants are shuffled, and what meets on a variant lies within the radius.  The
members of one variant are linked in a chain in order of fingerprint, never in
all pairs: with an even radius each of its links holds by construction (it is
verified all the same), and the chain connects what the pairs would connect.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.components import connected_components
from ledgerloom.llm.packs import PACKED, exchanged
from ledgerloom.plans import materialize, release

SEED = 42
#: Groups of more texts than this begin as stars.
SMALL = 2
#: For sets of fewer shingles than this it is counted out how often a bit differs.
FEW = 64
#: Words of the fingerprints that buckets see, in the first round and in the second, of only the texts of larger groups.
SKETCH, AGAIN = 2, 4
#: The place of a text in its batch, in the low bits of an entry.
_AT = np.uint64((1 << 14) - 1)
_DIGEST = xxhash.xxh64_intdigest


def shingle_hashes(text: str | None, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words, repeats included.

    A-Z are lower-cased and words end at ASCII white space.  A text of fewer
    words is one shingle; one without words, or null, has none.
    """
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    parts = zip(*(words[i:] for i in range(size))) if len(words) >= size else (words,)
    return np.array([_DIGEST(s, seed) for s in map(b" ".join, parts)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set when set in over half of ``hashes``; zero for none."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):  # bounds the memory for a very long text
        block = hashes[at : at + 65_536]
        ones += np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _remixed(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of the same shingles: a 64-bit finaliser over a salt."""
    if not salt:
        return hashes
    x = hashes + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majorities(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` fingerprints of the same shingles, by :func:`majority`."""
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 255):  # as many as a byte can count
        block = np.stack([_remixed(hashes[at : at + 255], salt) for salt in range(words)], axis=1)
        ones += np.unpackbits(block.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, words: int = 1) -> DataFrame:
    """``doc_id`` and the array ``fps`` of ``words`` 64-bit fingerprints."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text, shingle)
                found.append([majority(_remixed(hashes, salt)) for salt in range(words)])
            flat = np.array(found, dtype=np.uint64).view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat, pa.list_(pa.int64()))], ["doc_id", "fps"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fps array<bigint>")


def _ball(value: Column, bits: int, half: int) -> Column:
    """All values within ``half`` bits, as an array column."""
    masks = [0]
    for k in range(1, half + 1):
        masks += [sum(1 << b for b in chosen) for chosen in combinations(range(bits), k)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return F.transform(F.array(*map(F.lit, signed)), lambda m: value.bitwiseXOR(m))


def ball_links(points: DataFrame, key: str, bits: int, radius: int, also: str | None = None) -> DataFrame:
    """Links ``a``, ``b`` between distinct values of ``key`` within ``radius`` bits.

    ``radius`` is even.  With ``also``, ``a`` and ``b`` are the values of that
    column at either end.
    """
    if radius % 2 or not 0 <= radius <= 6:
        raise ValueError("radius must be 0, 2, 4 or 6")
    name = also or key
    spread = points.select(
        key, *([also] if also else []), F.explode(_ball(F.col(key), bits, radius // 2)).alias("variant")
    )
    near = Window.partitionBy("variant").orderBy(key)
    return (
        spread.select(
            F.lag(name).over(near).alias("a"), F.lag(key).over(near).alias("before"), F.col(name).alias("b"), F.col(key).alias("here")
        )
        .where(F.col("a").isNotNull() & (F.bit_count(F.col("before").bitwiseXOR(F.col("here"))) <= radius))
        .select("a", "b")
        .distinct()
    )


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Fingerprints link at ``radius`` or fewer differing bits, and a component is
    named by the least id reachable.  Rows with equal fingerprints are one
    node, so groups of copies cost nothing.  Null, empty and blank texts have
    fingerprint zero and link like any other; repeated rows each return; rows
    with a null id return too, but never name a component (null if all are
    null).  An empty table gives an empty table.
    """
    prints = materialize(
        fingerprints(docs, id_col, text_col, shingle).select("doc_id", F.col("fps")[0].alias("fp")), "fingerprints"
    )
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = connected_components(ball_links(nodes, "fp", 64, radius), "a", "b")
    joined = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = joined.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _prints(shingle: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, sizes, found = [], [], []
            for text in batch.column(2).to_pylist():
                hashes = np.unique(shingle_hashes(text, shingle))
                fps = majorities(hashes, words)
                same.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                sizes.append(len(hashes))
                found.append(fps.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int64()))],
                ["doc_id", "sum", "same", "size", "fps"],
            )

    return run


def most_apart(bits: int, similarity: float) -> int:
    """Bits of ``bits`` that sets of this similarity may differ in: five standard deviations above the mean.

    A bit differs with the angle between the sets; sets of one size have the widest.
    """
    return _within(math.acos(2 * similarity / (1 + similarity)) / math.pi, bits)


def _within(p: float, bits: int) -> int:
    return int(p * bits + 5 * math.sqrt(p * (1 - p) * bits))


def differing(a: int, b: int, both: int) -> float:
    """How likely a bit differs between sets of ``a`` and ``b`` shingles with ``both`` in common."""

    def set_given(ones: int, n: int) -> float:
        rest = n - both
        return sum(math.comb(rest, y) for y in range(rest + 1) if 2 * (ones + y) > n) / 2**rest

    found = 0.0
    for ones in range(both + 1):
        x, y = set_given(ones, a), set_given(ones, b)
        found += math.comb(both, ones) / 2**both * (x * (1 - y) + y * (1 - x))
    return found


@cache
def limits(bits: int, similarity: float) -> tuple[int, ...]:
    """As :func:`most_apart` by the smaller set's size, for all sizes from FEW on the last.

    The least overlap that allows the similarity differs most: each common
    shingle pulls both majorities the same way.
    """
    return tuple(_within(p, bits) for p in _chances(similarity)) + (most_apart(bits, similarity),)


@cache
def _chances(similarity: float) -> tuple[float, ...]:
    wide = math.acos(2 * similarity / (1 + similarity)) / math.pi
    out = [0.0]
    for a in range(1, FEW):
        least = [(b, math.ceil(similarity * (a + b) / (1 + similarity) - 1e-9)) for b in range(a, int(a / similarity + 1e-9) + 1)]
        out.append(max(wide, *(differing(a, b, both) for b, both in least)))
    return tuple(out)


def _planes(x: np.ndarray, kind: str) -> bytes:
    """Numbers byte by byte, which packs better."""
    return x.astype(kind).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _spread(tables: int, bits: int, half: int, buckets: int, sketch: int = SKETCH):
    """Balls of all keys: one packed row a bucket, which holds a share of every table's variants.

    ``sketch``: words of the fingerprints that go along.
    """
    masks = np.array([sum(1 << b for b in c) for k in range(half + 1) for c in combinations(range(bits), k)], np.uint64)

    def packed(parts: list[np.ndarray], node: np.ndarray, size: np.ndarray, root: np.ndarray, seen: np.ndarray) -> bytes:
        mine = np.concatenate(parts)
        used, index = np.unique(mine & _AT, return_inverse=True)
        used = used.astype(np.int64)
        variant = ((mine >> np.uint64(14)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        raw = np.array([len(x) for x in parts], "<i4").tobytes()
        raw += _planes(np.diff(variant, prepend=np.uint32(0)), "<u4") + _planes(index, "<u2")
        raw += _planes(np.diff(node[used], prepend=0), "<i8") + _planes(size[used], "<i4") + _planes(root[used] - node[used], "<i8")
        raw += seen[used].T.tobytes()
        head = np.array([len(mine), len(used), len(raw), tables, seen.shape[1]], "<i8").tobytes()
        return head + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1 << 13):
                batch = whole.slice(low, 1 << 13)
                node, size, root = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                words = np.asarray(batch.column(3).flatten()).view(np.uint64).reshape(len(node), -1)
                at = np.repeat(np.arange(len(node), dtype=np.uint64), len(masks))
                entries, cuts = [], []
                for t in range(tables):
                    key = (words[:, t // 2] >> np.uint64(32 * (t % 2))) & np.uint64((1 << bits) - 1)
                    variant = (key[:, None] ^ masks).ravel()
                    part = (((variant + np.uint64(t << 32)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(buckets)
                    entries.append(np.sort((part << np.uint64(46)) | (variant << np.uint64(14)) | at))
                    cuts.append(np.searchsorted(entries[-1], np.arange(buckets + 1, dtype=np.uint64) << np.uint64(46)).tolist())
                rows = []
                for p in range(buckets):
                    parts = [e[c[p] : c[p + 1]] for e, c in zip(entries, cuts)]
                    if any(map(len, parts)):
                        rows.append((p, packed(parts, node, size, root, words[:, :sketch])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "payload"]
                )

    return run


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    """Every table's entries, with variant and index, and every index's node, size, root and sketch."""
    n, m, length, tables, width = np.frombuffer(blob, "<i8", 5).tolist()
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob[40:], length, asbytes=True), np.uint8)
    at = 4 * tables
    counts = raw[:at].view("<i4").astype(np.int64)

    def take(count: int, kind: str) -> np.ndarray:
        nonlocal at
        width = np.dtype(kind).itemsize
        out = np.ascontiguousarray(raw[at : at + count * width].reshape(width, count).T).view(kind).ravel()
        at += count * width
        return out

    variant, index = np.cumsum(take(n, "<u4"), dtype=np.uint32), take(n, "<u2")
    node = np.cumsum(take(m, "<i8"))
    size, root = take(m, "<i4"), take(m, "<i8") + node
    sketch = np.frombuffer(raw[at:].tobytes(), np.uint64).reshape(width, m).T
    return counts, variant, index, node, size, root, sketch


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The payloads of each bucket of sorted rows."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for _, found in groupby(rows, lambda row: row[0]):
        yield [payload for _, payload in found]


def _crossing(who: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one group that different components hold, some at a time."""
    names, where, counts = np.unique(root, return_inverse=True, return_counts=True)
    order = np.lexsort((where, counts[where]))  # the largest component last
    who, where = who[order], where[order]
    ends = np.append(np.flatnonzero(where[1:] != where[:-1]) + 1, len(where))
    for begin, end in zip([0, *ends[:-2].tolist()], ends[:-1].tolist()):
        rest = len(who) - end
        step = max(1, (1 << 20) // rest)
        for low in range(begin, end, step):
            mine = who[low : min(low + step, end)]
            yield np.repeat(mine, rest), np.tile(who[end:], len(mine))


def _meet(similarity: float, bits: int, again: bool):
    """Pairs ``a``, ``b`` that meet on a variant and whose sizes and sketches allow the similarity.

    First, all pairs of a group of up to SMALL texts, and a star for a larger
    one, whose texts are also given as ``a`` alone.  ``again``: of the larger
    groups, all pairs that the components do not join yet.  A sketch is part of
    the fingerprints; what its bits say, but for those of the key that a pair met
    on, keeps most unlike pairs in the bucket.
    """

    def pairs_of(blobs: list[bytes]) -> Iterator[np.ndarray]:
        parts = [_unpacked(b) for b in blobs]
        base = np.cumsum([0, *(len(p[3]) for p in parts)])
        node, size, root, sketch = (np.concatenate([p[i] for p in parts]) for i in range(3, 7))
        cuts = [np.cumsum([0, *p[0].tolist()]) for p in parts]
        for t in range(len(parts[0][0])):
            here = np.full(sketch.shape[1], ~np.uint64(0))
            if t // 2 < len(here):
                here[t // 2] ^= np.uint64(((1 << bits) - 1) << (32 * (t % 2)))
            allowed = np.array(limits(int(np.bitwise_count(here).sum()), similarity))

            def fit(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                ok = np.flatnonzero(np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9)
                i, j = i[ok], j[ok]
                apart = np.bitwise_count((sketch[i] ^ sketch[j]) & here).sum(axis=1, dtype=np.int64)  # noqa: B023
                ok = apart <= allowed[np.minimum(np.minimum(size[i], size[j]), FEW)]  # noqa: B023
                a, b = node[i[ok]], node[j[ok]]
                return np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)

            variant = np.concatenate([p[1][c[t] : c[t + 1]] for p, c in zip(parts, cuts)])
            who = np.concatenate([p[2][c[t] : c[t + 1]].astype(np.int64) + low for p, c, low in zip(parts, cuts, base.tolist())])
            if len(variant):
                yield from groups_of(variant, who, node, root, fit)

    def groups_of(variant: np.ndarray, who: np.ndarray, node: np.ndarray, root: np.ndarray, fit) -> Iterator[np.ndarray]:
        order = np.lexsort((node[who], variant))  # the centre of a star is the same in all buckets
        variant, who = variant[order], who[order]
        at = np.flatnonzero(np.concatenate([[True], variant[1:] != variant[:-1]]))
        counts = np.diff(np.append(at, len(variant)))
        held = np.repeat(counts, counts)
        crowd = held > SMALL
        if again:
            for low, n in zip(at[counts > SMALL].tolist(), counts[counts > SMALL].tolist()):
                mine = who[low : low + n]
                if (root[mine] != root[mine[0]]).any():
                    for found in _crossing(mine, root[mine]):
                        yield fit(*found)
            return
        for lag in range(1, min(SMALL, int(counts.max()))):
            i = np.flatnonzero(~crowd[lag:] & (variant[lag:] == variant[:-lag]))
            yield fit(who[i], who[i + lag])
        if crowd.any():
            yield fit(who[np.repeat(at, counts)[crowd]], who[crowd])
            mine = node[who[crowd]]
            yield np.stack([mine, np.full(len(mine), -1)], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in _buckets(batches):
            held, n = [], 0
            for found in pairs_of(blobs):
                held.append(found[found[:, 0] != found[:, 1]])
                n += len(held[-1])
                if n > 1 << 21:
                    held = [np.unique(np.concatenate(held), axis=0)]
                    n = 0
            if held:
                out = np.unique(np.concatenate(held), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    return run


def similar_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    tables: int = 24,
    bits: int = 28,
) -> DataFrame:
    """``doc_id``, ``sum`` (hash of the text), ``root`` and ``component_id``.

    As :func:`near_duplicates`; ``root`` tells components apart that the same
    id names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = rows.select("doc_id", F.xxhash64("text").alias("sum"), "text")
    prints = materialize(
        keyed.mapInArrow(_prints(shingle, tables // 2), f"doc_id {dict(rows.dtypes)['doc_id']}, sum bigint, same binary, size int, fps array<bigint>"),
        "fingerprints",
    )
    nodes = materialize(
        prints.groupBy("same")
        .agg(F.min("doc_id").alias("first"), F.min("sum").alias("sum"), F.any_value("size").alias("size"), F.any_value("fps").alias("fps"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(parts, 1 << 13)

    def meet(points: DataFrame, again: bool) -> DataFrame:
        packed = points.select("node", "size", "root", "fps").mapInArrow(_spread(tables, bits, 1, buckets, AGAIN if again else SKETCH), PACKED)
        return exchanged(packed, parts).mapInArrow(_meet(similarity, bits, again), "a bigint, b bigint").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                s, t = (np.unique(shingle_hashes(z, shingle)) for z in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(both >= similarity * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda end, fps: nodes.select(F.col("node").alias(end), F.col("fps").alias(fps), F.col("size").alias(f"{fps}_size"))
        apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
        allowed = F.array(*map(F.lit, limits(32 * tables, similarity)))[F.least("x_size", "y_size", F.lit(FEW))]
        near = materialize(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(apart <= allowed).select("a", "b"), "links")
        ends = near.select(F.col("a").alias("node")).unionAll(near.select("b")).distinct()
        wanted = nodes.join(ends, "node").select("node", "sum")
        texts = materialize(
            keyed.select("sum", "text").join(wanted, "sum").dropDuplicates(["node"]).select("node", "text"), "texts"
        )
        both = near.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a").join(
            texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b"
        )
        good = materialize(both.select("a", "b", "left", "right").mapInArrow(verify, "a bigint, b bigint"), "similar")
        release(near)
        release(texts)
        return good

    met = materialize(meet(nodes.withColumn("root", F.col("node")), False), "met")
    links = verified(met.where("b >= 0"))
    roots = connected_components(links, "a", "b")
    crowded = materialize(met.where("b < 0").select(F.col("a").alias("node")), "crowded")
    release(met)
    if crowded.limit(1).count():
        # A star settles what is like its centre; the others are compared with all.
        known = nodes.join(crowded, "node", "left_semi").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        more = verified(meet(known, True))
        roots = connected_components(links.unionAll(more), "a", "b")
        release(more)
    release(crowded)
    release(links)
    joined = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(joined.join(named, "root").select("same", "root", "component_id"), "same").select("doc_id", "sum", "root", "component_id")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    tables: int = 24,
    bits: int = 28,
) -> DataFrame:
    """``doc_id`` and ``component_id`` by Jaccard similarity of word shingles.

    One fingerprint of 64 bits at radius 2 finds few pairs at a similarity of
    0.8, so ``tables`` (an even number) fingerprints of ``bits`` bits each emit
    their balls of radius 1.  All pairs that meet in any of them are verified on
    the texts' whole shingle sets, unless components of verified pairs join
    them already, or more of their fingerprints' bits differ than five standard
    deviations allow (of what is counted out for sets of few shingles).  Found at a
    similarity of 0.8: about 99 %, at 0.9: over 99.99 %, for each pair by
    itself, if the sets are not very small.  Fingerprints are those of the distinct shingles, and texts
    whose sets have one 128-bit digest are one node.  Texts without words are
    alike.  Nulls as in :func:`simhash_components`.
    """
    return similar_texts(docs, id_col, text_col, shingle, similarity, tables, bits).select("doc_id", "component_id")
