"""Log files: records as length-prefixed canonical JSON frames.

A frame is a big-endian 32-bit length and so many bytes.  A file that ends
within a frame was cut off while it was written; the torn rest is no record.
Frames are not splittable, so a file is one partition and many files are read
in parallel; the file's size is checked before it is read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerloom.functions.canonical import CanonicalError, dumps, loads
from ledgerloom.functions.records import RECORD_COLUMNS, Record
from ledgerloom.functions.schemas import PayloadError

MAX_LOG_BYTES = 64 << 20

class FrameError(ValueError):
    """A file or record beyond the bounds, or a frame that holds no record."""


def encode(record: Record, room: int | None = None) -> bytes:
    """A record's frame; ``room`` is what the file's bound leaves."""
    body = dumps(record.written())
    if len(body) >= 1 << 32 or room is not None and len(body) + 4 > room:
        raise FrameError("the record does not fit")
    return struct.pack(">I", len(body)) + body


def split(data: bytes) -> tuple[list[bytes], int]:
    """Bodies of all whole frames, and where the last of them ends."""
    bodies, at = [], 0
    while len(data) - at >= 4:
        (size,) = struct.unpack_from(">I", data, at)
        if len(data) - at - 4 < size:
            break
        bodies.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return bodies, at


def read_log(data: bytes, most: int = MAX_LOG_BYTES) -> tuple[list[Record], int]:
    """Records of a log file, and the length of its whole frames."""
    if len(data) > most:
        raise FrameError(f"the log exceeds {most} bytes")
    bodies, end = split(data)
    try:
        return [Record.read(loads(b)) for b in bodies], end
    except (CanonicalError, PayloadError) as e:
        raise FrameError(f"a frame holds no record: {e}") from None


class FrameLogSource(DataSource):
    """``spark.read.format("frame_log").option("paths", "a,b").load()``.

    Paths are local to all executors (a shared mount); for other stores use
    :func:`frame_records`.  ``max_bytes`` bounds a file.
    """

    @classmethod
    def name(cls) -> str:
        return "frame_log"

    def schema(self) -> str:
        return RECORD_COLUMNS

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in (options.get("paths") or options.get("path", "")).split(",") if p]
        self.most = int(options.get("max_bytes", MAX_LOG_BYTES))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            records, _ = read_log(f.read(self.most + 1), self.most)
        for pos, r in enumerate(records):
            yield r.row(partition.value, pos)


def frame_records(files: DataFrame, most: int = MAX_LOG_BYTES) -> DataFrame:
    """Records of log files in any store that Spark reads.

    ``files`` has ``path`` and ``content``, as ``spark.read.format("binaryFile")``
    gives them, globs included.  A file that holds no log, or is larger than
    ``most``, fails the query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                records, _ = read_log(data or b"", most)
                for low in range(0, len(records), 4096):
                    rows = [r.row(path, low + i) for i, r in enumerate(records[low : low + 4096])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    names = [x.split()[0] for x in RECORD_COLUMNS.replace("struct<type:string,target:binary>", "s").replace("struct<key_id:string,sig:binary>", "s").split(", ")]
    ref = pa.list_(pa.struct([("type", pa.string()), ("target", pa.binary())]))
    kinds = [
        pa.string(), pa.int64(), *[pa.binary()] * 3, pa.decimal128(20, 0), *[pa.string()] * 3, pa.binary(), pa.binary(), ref, pa.string(),
        pa.struct([("key_id", pa.string()), ("sig", pa.binary())]),
    ]
    return files.select(F.col("path"), F.col("content")).mapInArrow(run, RECORD_COLUMNS)
