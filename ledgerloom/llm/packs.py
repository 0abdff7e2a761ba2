"""Columns of numbers packed into binary rows by bucket, and read bucket by bucket.

A shuffle of a row for every position of every text is mostly overhead.  A batch
sends one row a bucket instead, with its entries column by column; after the
exchange rows are sorted by bucket (Spark spills that sort), so a Python worker
holds one bucket at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of input that a bucket takes, about.  Every bucket is a partition of its own.
PART_BYTES = 256 << 20
PACKED = "bucket int, payload binary"


def parts_for(df: DataFrame) -> int:
    """Shuffle partitions for work on ``df``: as configured, or more by its estimated bytes.

    Spark knows the bytes of files and estimates what comes of them; of other
    rows it says about 8 EB, which stands for unknown.
    """
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return conf if size >= 1 << 56 else max(conf, -(-size // PART_BYTES))


def pack(columns: list[np.ndarray], plain: int) -> bytes:
    """Columns of one length; all but the first ``plain`` as differences."""
    raw = b"".join(
        (c.astype(np.int64) if i < plain else np.diff(c.astype(np.int64), prepend=0)).view(np.uint8).reshape(-1, 8).T.tobytes()
        for i, c in enumerate(columns)
    )
    return np.array([len(columns), len(columns[0]), plain], "<i8").tobytes() + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    k, n, plain = np.frombuffer(blob, "<i8", 3).tolist()
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob[24:], 8 * k * n, asbytes=True), np.uint8).reshape(k, 8, n)
    out = [np.ascontiguousarray(c.T).view(np.int64).ravel() for c in raw]
    return out[:plain] + [np.cumsum(c) for c in out[plain:]]


def dealt(bucket: np.ndarray, columns: list[np.ndarray], plain: int) -> pa.RecordBatch:
    """One packed row a bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    rows = [pack([c[order[a:b]] for c in columns], plain) for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(rows, pa.binary())], ["bucket", "payload"]
    )


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each bucket of sorted rows with its columns joined."""
    now, held = None, []
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if b != now and held:
                yield now, [np.concatenate(x) for x in zip(*map(unpack, held))]
                held = []
            now = b
            held.append(blob)
    if held:
        yield now, [np.concatenate(x) for x in zip(*map(unpack, held))]


def exchanged(packed: DataFrame, parts: int) -> DataFrame:
    """Packed rows by bucket, in order of it within a partition."""
    return packed.repartitionById(parts, "bucket").sortWithinPartitions("bucket")


def groups(*keys: np.ndarray) -> np.ndarray:
    """Where a sorted run of equal keys begins."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def heads(new: np.ndarray) -> np.ndarray:
    """For each entry of sorted groups, the index of its group's first entry."""
    return np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.empty(0, np.int64)
