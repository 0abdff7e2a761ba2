"""A corpus pipeline out of five of the training-data operators.

Each stage takes (spark, docs, sf_dir), works on all documents that its
predecessor kept and returns a DataFrame, which :func:`run` writes as Parquet
and reads again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.decontaminate import decontaminate
from ledgerloom.llm.langid import UNKNOWN, identify
from ledgerloom.llm.mixing import mix_sources
from ledgerloom.llm.simhash import similar_texts
from ledgerloom.llm.suffix import remove_repeats
from ledgerloom.plans import materialize

#: A text goes if no language has this share of its words.
LEAST_SHARE = 0.4


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows under names that no operator uses, and the names of the given columns.

    Whatever else the table holds, nothing of it clashes with what stages add.
    """
    names = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def given(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """The given columns under their own names."""
    return rows.select(*(F.col(new).alias(old) for old, new in names.items()))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a recognised language.

    A document goes only if its text is null or has no letter, or if no learned
    language has 40 % of its words; mixed texts with a main language stay.
    """
    rows, names = plain(docs)
    found = identify(rows, names["doc_id"], names["text"], names["lang"])
    return given(found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SHARE)), names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of every group of near-duplicates.

    Of rows that repeat that id with texts of the group, one stays; with other
    texts, the id stays once for each of their groups.  Rows without an id all
    stay.
    """
    rows, names = plain(docs)
    doc_id, text = names["doc_id"], names["text"]
    linked = similar_texts(rows, doc_id, text)
    one = linked.where("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "sum")).alias("one"))
    classes = one.select(F.col("one.doc_id").alias(doc_id), F.col("one.sum").alias("sum"))
    keyed = rows.where(F.col(doc_id).isNotNull()).withColumn("sum", F.xxhash64(F.col(text).cast("string")))
    kept = keyed.join(classes, [doc_id, "sum"], "left_semi").dropDuplicates([doc_id, "sum"]).drop("sum")
    return given(kept.unionByName(rows.where(F.col(doc_id).isNull())), names)


def span_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut byte strings that repeat an earlier document's out of the texts.

    A character that a cut splits goes as a whole.  Documents that lose all of
    their text go; those that had none stay.  ``n_chars`` counts what is left.
    """
    rows, names = plain(docs)
    doc_id, text = names["doc_id"], names["text"]
    others = tuple(c for c in names.values() if c != text)
    cut = remove_repeats(rows.withColumn("none", F.isnull(text)), doc_id, text, as_text=True, keep=(*others, "none"))
    # What was null comes back as "".
    out = cut.where("kept <> '' or n_removed = 0").withColumn(text, F.when(~F.col("none"), F.col("kept")))
    if "n_chars" in names:
        out = out.withColumn(names["n_chars"], F.length(text).cast(dict(docs.dtypes)["n_chars"]))
    return given(out, names)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that leak no benchmark item."""
    rows, names = plain(docs)
    return given(decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), names["doc_id"], names["text"]), names)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of every document for the mix; documents with none are left out.

    Columns of the names of the results are replaced by those.
    """
    added = ("size", "source_size", "target", "copies")
    rows, names = plain(docs)
    # A row's number reaches it whatever its id, null or repeated.
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    mixed = mix_sources(rows, names["doc_id"], names["text"], names["source"], keep=("row",)).where("copies > 0").select("row", *added)
    kept = {old: new for old, new in names.items() if old not in added}
    return rows.join(mixed, "row").select(*(F.col(new).alias(old) for old, new in kept.items()), *added)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("span_dedup", span_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


#: Learned models and fingerprints have no SQL; the stages are tested one by one.
ORACLE_SQL = None
