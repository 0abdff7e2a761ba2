"""WARC records with a Merkle fixity audit of replicas.

Records lie in archive files in order; a leaf is the SHA-256 of a record's
bytes with its length and the gap before it, which together are its range of
offsets.  Sixteen nodes in order make a node of the next level, which hashes
their places, lengths and hashes, first within a file up to its root, then over
the files up to one root.  An audit compares the roots of two replicas and
descends only into branches that differ, level by level, with equi-joins on the
node's place; every level's findings are written before the next one reads them.

Ranges are hashed as lengths and gaps, not as absolute offsets: padding and
truncation are found, and yet a record of another length is the only one that
differs, though all behind it have moved.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.plans import materialize, release

#: Children of a node.
FANOUT = 16
#: Consecutive ids in an archive file.
PER_FILE = 4096
#: Files that share the records without an id.
LOOSE = 1 << 16


def record_uuid(*parts: Column) -> Column:
    """A ``urn:uuid`` that is a hash of the parts; nulls count as empty."""
    h = F.md5(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    cut = (F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12)))
    first, second, third, fourth, last = cut
    return F.concat(F.lit("<urn:uuid:"), first, F.lit("-"), second, F.lit("-3"), third, F.lit("-8"), fourth, F.lit("-"), last, F.lit(">"))


def warc_record(url: Column, payload: Column, record_id: Column | None = None, date: Column | None = None) -> Column:
    """A WARC 1.0 resource record as a string; nulls count as empty.

    The standard asks for ``record_id`` (see :func:`record_uuid`) and ``date`` (a
    timestamp, written in UTC seconds); left out, the record has no such fields
    and is good for hashing only.
    """
    url, payload = F.coalesce(url, F.lit("")), F.coalesce(payload, F.lit(""))
    named = [] if record_id is None else [F.lit("WARC-Record-ID: "), record_id, F.lit("\r\n")]
    dated = [] if date is None else [F.lit("WARC-Date: "), F.date_format(F.to_utc_timestamp(F.coalesce(date, F.timestamp_seconds(F.lit(0))), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("\r\n")]
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\n"), *named, *dated, F.lit("WARC-Target-URI: "), url,
        F.lit("\r\nWARC-Block-Digest: sha256:"), F.sha2(payload, 256),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"),
    )


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(begin, end, fields, block) of every record of a WARC file, plain or gzip by record.

    Field names are lower-cased; offsets are those in the file.  Bytes between
    records (padding) belong to none; reading ends at bytes that are no record.
    """
    at, packed = 0, data[:2] == b"\x1f\x8b"
    while at < len(data):
        if packed:
            opened = zlib.decompressobj(31)
            try:
                raw = opened.decompress(data[at:]) + opened.flush()
            except zlib.error:
                return
            if not opened.eof:
                return
            begin, end = at, len(data) - len(opened.unused_data)
        else:
            begin = data.find(b"WARC/", at)
            if begin < 0:
                return
            raw, end = data, None
        low = 0 if packed else begin
        head = raw.find(b"\r\n\r\n", low)
        if head < 0 or not raw.startswith(b"WARC/", low):
            return
        lines = raw[low:head].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = fields.get("content-length", "")
        if not size.isdigit() or head + 4 + int(size) > len(raw):
            return
        stop = head + 4 + int(size)
        tail = stop + 4 if raw[stop : stop + 4] == b"\r\n\r\n" else stop
        yield begin, end if packed else tail, fields, raw[head + 4 : stop]
        at = end if packed else tail


def packed_record(record: bytes) -> bytes:
    """A record as a gzip member of its own; the same bytes always."""
    return gzip.compress(record, mtime=0)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files (``.warc`` or, compressed by record, ``.warc.gz``).

    Returns ``path``, ``place`` (in the file), ``begin``, ``end``, ``hash`` (SHA-256 of
    the bytes from ``begin`` to ``end``), ``record_id``, ``type``, ``uri``,
    ``date``, ``digest`` (as the record gives it), ``intact`` (whether a
    ``sha256`` block digest agrees, null without one) and ``block``.  A file is
    read by one task.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    fields = "path string, place bigint, begin bigint, end bigint, hash string, record_id string, type string, uri string, date string, digest string, intact boolean, block binary"
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for place, (begin, end, head, block) in enumerate(parse_records(data)):
                    digest = head.get("warc-block-digest")
                    intact = digest[7:] == hashlib.sha256(block).hexdigest() if digest and digest.startswith("sha256:") else None
                    whole = hashlib.sha256(data[begin:end]).hexdigest()
                    rows.append((name, place, begin, end, whole, *(head.get(k) for k in ("warc-record-id", "warc-type", "warc-target-uri", "warc-date")), digest, intact, block))
                    if len(rows) == 1024:
                        yield _batch(rows, names)
                        rows = []
                if rows:
                    yield _batch(rows, names)

    return files.mapInArrow(run, fields)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.int64()] * 3, *[pa.string()] * 6, pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def file_leaves(records: DataFrame) -> DataFrame:
    """Leaves of records that :func:`read_warc` found.

    Files are told apart by the last part of their path, which replicas share,
    and numbered by a hash of it.  ``id`` is the record's id.
    """
    base = F.regexp_extract("path", "[^/]*$", 0)
    rows = records.select(F.pmod(F.xxhash64(base), F.lit(1 << 40)).alias("file"), "place", F.col("record_id").alias("id"), "begin", "end", "hash")
    return _leaf(rows)


def _leaf(rows: DataFrame) -> DataFrame:
    """Adds ``node``, the hash of a record with its length and the gap before it."""
    before = F.lag("end", 1, 0).over(Window.partitionBy("file").orderBy("place"))
    told = F.concat_ws(":", "hash", (F.col("end") - F.col("begin")).cast("string"), (F.col("begin") - F.col("before")).cast("string"))
    return rows.withColumn("before", before).select("file", "place", "id", "begin", "end", "hash", F.sha2(told, 256).alias("node"))


def leaves(records: DataFrame, id_col: str, record_col: str, order_by: Column | None = None) -> DataFrame:
    """``file``, ``place``, ``id``, ``begin``, ``end``, ``hash`` and ``node`` of every record.

    A file takes 4,096 consecutive integer ids; records without an id go to one
    of 65,536 further files by hash, 4,096 identical ones at a time.  In a file records stand in order of id,
    then ``order_by`` (by default the hash), so identical rows may trade places
    without any effect.  Offsets are bytes within the file.  ``node`` hashes the
    record's hash, its length and the gap before it.
    """
    order = F.sha2(F.col(record_col), 256) if order_by is None else order_by
    rows = records.select(
        F.col(id_col).alias("id"),
        F.sha2(F.col(record_col), 256).alias("hash"),
        F.octet_length(record_col).cast("long").alias("size"),
        order.alias("by"),
    )
    # Identical records without an id are interchangeable: they are counted, and dealt in blocks.
    block = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PER_FILE)))
    held = F.least(F.lit(PER_FILE), F.col("n") - F.col("block") * PER_FILE).cast("int")
    loose = (
        rows.where("id is null").groupBy("id", "hash", "size", "by").agg(F.count("*").alias("n")).withColumn("block", block)
        .select("id", "hash", "size", "by", (F.lit(-1) - F.pmod(F.xxhash64("by", "block"), F.lit(LOOSE))).cast("long").alias("file"),
                F.explode(F.sequence(F.lit(1), held)).alias("copy")).drop("copy")
    )
    rows = rows.where("id is not null").withColumn("file", F.floor(F.col("id") / PER_FILE).cast("long")).unionAll(loose)
    within = Window.partitionBy("file").orderBy(F.col("id").asc_nulls_first(), "by", "hash")
    end = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))
    told = F.sha2(F.concat_ws(":", "hash", F.col("size").cast("string"), F.lit("0")), 256)  # such files have no gaps
    return rows.select(
        "file", (F.row_number().over(within) - 1).cast("long").alias("place"), "id", (end - F.col("size")).alias("begin"),
        end.alias("end"), "hash", told.alias("node"),
    )


def _up(nodes: DataFrame) -> DataFrame:
    """The next level: the nodes that name a parent become that node."""
    child = F.struct("place", "begin", "end", "hash")
    told = F.transform("c", lambda x: F.concat_ws(":", x["place"].cast("string"), (x["end"] - x["begin"]).cast("string"), x["hash"]))
    return (
        nodes.groupBy(F.col("up_file").alias("file"), F.col("up_place").alias("place"))
        .agg(F.array_sort(F.collect_list(child)).alias("c"))
        .select(
            "file", "place", F.col("c")[0]["begin"].alias("begin"), F.element_at("c", -1)["end"].alias("end"),
            F.sha2(F.array_join(told, ","), 256).alias("hash"),
        )
    )


def shape(*replicas: DataFrame) -> tuple[int, int, int] | None:
    """Largest place in a file, least and largest file over all replicas; null if none has a record."""
    found = [r.agg(F.max("place"), F.min("file"), F.max("file")).first() for r in replicas]
    found = [x for x in found if x[0] is not None]
    return found and (max(x[0] for x in found), min(x[1] for x in found), max(x[2] for x in found)) or None


def tree(leaf: DataFrame, form: tuple[int, int, int]) -> list[DataFrame]:
    """Levels from the leaves up to the root, each written to the shared folder.

    Nodes have ``file``, ``place``, their parent's ``up_file`` and ``up_place``,
    ``begin``, ``end`` and ``hash``.  Levels over files have file 0 and count
    their range in files.
    """
    most, low, high = form
    inner = F.floor(F.col("place") / FANOUT)
    now = leaf.select("file", "place", "begin", "end", F.col("node").alias("hash"))
    levels = []

    def add(up_file: Column, up_place: Column) -> DataFrame:
        levels.append(now.withColumns({"up_file": up_file.cast("long"), "up_place": up_place.cast("long")}))
        levels[-1]._scratch_path = getattr(now, "_scratch_path", None)
        return materialize(_up(levels[-1]), "level")

    while most >= FANOUT:
        now = add(F.col("file"), inner)
        most //= FANOUT
    now = add(F.lit(0), F.col("file") - F.lit(low))
    most = high - low
    while most > 0:
        now = add(F.lit(0), inner)
        most //= FANOUT
    root = now.withColumns({"up_file": F.lit(0).cast("long"), "up_place": F.lit(0).cast("long")})
    root._scratch_path = now._scratch_path
    return [*levels, root]


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records in which two replicas differ, found by descent from the roots.

    Takes two results of :func:`leaves` and returns ``file``, ``place``, ``id``,
    ``begin`` and ``end`` (of the left replica, or of the right one where the
    left has no such record), ``left_hash`` and ``right_hash`` (null where a
    replica lacks the record).  Replicas with equal roots give no rows.  A
    record differs by its bytes, by its length or by the gap before it (padding;
    its hashes are then equal); behind a record of another length offsets shift,
    and still only that record differs.  A record lost in the middle of a file
    moves those behind it, and all of them are reported.
    """
    mine, other = materialize(left, "leaves"), materialize(right, "leaves")
    form = shape(mine, other)
    bad = mine.select("file", "place")
    if form:
        levels = list(zip(tree(mine, form), tree(other, form)))
        for depth, (a, b) in enumerate(reversed(levels)):
            if depth:
                up = [F.col("up_file") == F.col("bad.file"), F.col("up_place") == F.col("bad.place")]
                a, b = (x.join(bad.alias("bad"), up, "left_semi") for x in (a, b))
            same = F.expr("x.file = y.file and x.place = y.place")
            then = materialize(
                a.alias("x").join(b.alias("y"), same, "full").where("not (x.hash <=> y.hash)")
                .select(F.coalesce("x.file", "y.file").alias("file"), F.coalesce("x.place", "y.place").alias("place")),
                "differs",
            )
            release(bad)
            bad = then
            if not bad.limit(1).count():
                bad = mine.select("file", "place").limit(0)
                break
        for a, b in levels:  # what is left needs the leaves alone
            release(a)
            release(b)
    found = bad.alias("k")
    for name, side in (("x", mine), ("y", other)):
        found = found.join(side.alias(name), F.expr(f"k.file = {name}.file and k.place = {name}.place"), "left")
    return found.select(
        "k.file", "k.place", *(F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in ("id", "begin", "end")),
        F.col("x.hash").alias("left_hash"), F.col("y.hash").alias("right_hash"),
    )


def root_hash(levels: list[DataFrame]) -> str | None:
    """The hash of a tree's root; null for an empty archive."""
    row = levels[-1].select("hash").first()
    return row and row[0]
