"""Replay as relations: many logs, or long ones, checked with joins and windows.

Every stored verdict is assumed to be right, the state before each record is
derived from them, and each check is recomputed against it; the first failing
position of a log is then its verdict.  Up to there all earlier verdicts were
right, so the assumed state is the replayed one; later positions don't count.

``records`` is the table that the sources make: log_id, pos, id, space, thread,
time, author, author_type, kind, schema, data, refs, evidence and signature.  All joins
carry ``log_id``.  Payload fields are read from the canonical JSON bytes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.canonical import loads
from ledgerloom.functions.records import Record, Rules, payload
from ledgerloom.functions.schemas import EVIDENCE, REF_TYPES, Dialect
from ledgerloom.operators.graph import taint_times
from ledgerloom.operators.judge import Ledger, replay


def _field(name: str) -> Column:
    return F.get_json_object(F.decode("data", "utf-8"), f"$.{name}")


def _hash(name: str) -> Column:
    """A 32-byte field, which JSON writes as an array of numbers."""
    numbers = F.from_json(_field(name), "array<int>")
    return F.unhex(F.array_join(F.transform(numbers, lambda b: F.lpad(F.hex(b), 2, "0")), ""))


def _rank(column: Column, names: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), column) - 1


def edges(records: DataFrame) -> DataFrame:
    """References as rows: log_id, src, src_time, type, ordinal, dst."""
    return records.select(
        "log_id", F.col("id").alias("src"), F.col("time").alias("src_time"), F.posexplode("refs").alias("ordinal", "ref")
    ).select("log_id", "src", "src_time", F.col("ref.type").alias("type"), "ordinal", F.col("ref.target").alias("dst"))


def ledger(records: DataFrame) -> DataFrame:
    """Records but verdicts, each with its stored verdict: ``accepted``, ``reason``, ``ret_time`` and ``taint_time``."""
    verdicts = records.where("kind = 'Verdict' and size(refs) = 1").select(
        "log_id", F.col("refs")[0]["target"].alias("id"), (_field("result") == "Accept").alias("accepted"), _field("reason").alias("reason")
    )
    judged = records.where("kind <> 'Verdict'").join(verdicts, ["log_id", "id"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    gone = judged.where("kind = 'Retraction' and accepted").groupBy("log_id", _hash("target_id").alias("id")).agg(F.min("time").alias("ret_time"))
    judged = judged.join(gone, ["log_id", "id"], "left")
    live = judged.where("accepted").select("log_id", "id", "time", "ret_time")
    used = edges(judged.where("accepted")).where("type in ('Use', 'Require')")
    return judged.join(taint_times(live, used), ["log_id", "id"], "left")


def chain_failures(records: DataFrame) -> DataFrame:
    """``log_id`` and ``pos`` of records whose time does not count on, or whose pair is broken."""
    order = Window.partitionBy("log_id").orderBy("pos")
    step = F.when(F.col("pos") == 0, F.col("time") == 1).otherwise(F.col("time") == F.lag("time").over(order) + 1)
    answered = (F.lead("kind").over(order) == "Verdict") & (F.lead("refs").over(order)[0]["target"] == F.col("id"))
    paired = F.when(F.col("pos") % 2 == 0, (F.col("kind") != "Verdict") & F.coalesce(answered, F.lit(False))).otherwise(F.col("kind") == "Verdict")
    return records.select("log_id", "pos", step.alias("step"), paired.alias("paired")).where("not step or not paired").select("log_id", "pos")


def reference_failures(records: DataFrame, judged: DataFrame) -> DataFrame:
    """First failing reference of each record: ``log_id``, ``pos``, ``id``, ``reason``.

    References must ascend, resolve to an earlier record of the same space, and
    a required record must be accepted and neither retracted nor tainted yet.
    """
    ranked = F.transform("refs", lambda r: F.struct(_rank(r["type"], REF_TYPES).alias("t"), r["target"].alias("x")))
    ascending = F.forall(F.sequence(F.lit(1), F.size("ranked")), lambda i: (i == 1) | (F.get("ranked", i - 2) < F.get("ranked", i - 1)))
    subjects = records.where("kind <> 'Verdict'")
    unsorted = subjects.withColumn("ranked", ranked).where((F.size("refs") > 1) & ~ascending).select("log_id", "id", F.lit(-1).alias("ordinal"), F.lit("InvalidPayload").alias("reason"))
    targets = records.select("log_id", F.col("id").alias("dst"), F.col("space").alias("dst_space"), F.col("time").alias("dst_time"))
    states = judged.select("log_id", F.col("id").alias("dst"), "accepted", "ret_time", "taint_time")
    met = (
        edges(subjects).join(records.select("log_id", F.col("id").alias("src"), "space"), ["log_id", "src"])
        .join(targets, ["log_id", "dst"], "left").join(states, ["log_id", "dst"], "left")
    )
    usable = F.coalesce("accepted", F.lit(False)) & ~F.coalesce(F.least("ret_time", "taint_time") < F.col("src_time"), F.lit(False))
    reason = (
        F.when(F.col("dst_time").isNull() | (F.col("dst_time") >= F.col("src_time")), "RefUnresolved")
        .when(F.col("dst_space") != F.col("space"), "RefCrossSpace")
        .when((F.col("type") == "Require") & ~usable, "RefUnresolved")
    )
    failed = met.select("log_id", F.col("src").alias("id"), "ordinal", reason.alias("reason")).where("reason is not null")
    first = unsorted.unionAll(failed).groupBy("log_id", "id").agg(F.min_by("reason", "ordinal").alias("reason"))
    return first.join(records.select("log_id", "id", "pos"), ["log_id", "id"]).select("log_id", "pos", "id", "reason")


def evidence_failures(records: DataFrame, judged: DataFrame, dialect: Dialect) -> DataFrame:
    """Records whose evidence is not the weakest of their schema's and of what they use at that time."""
    base = F.lit(len(EVIDENCE) - 1)
    for schema in dialect.ids:
        base = F.when(F.col("schema") == F.lit(schema), dialect.base_evidence(schema)).otherwise(base)
    subjects = records.where("kind <> 'Verdict'").select("log_id", "pos", "id", base.alias("base"), _rank(F.col("evidence"), EVIDENCE).alias("stored"))
    states = judged.select("log_id", F.col("id").alias("dst"), "accepted", "ret_time", "taint_time", _rank(F.col("evidence"), EVIDENCE).alias("its"))
    known = records.select("log_id", F.col("id").alias("dst"))
    usable = F.coalesce("accepted", F.lit(False)) & ~F.coalesce(F.least("ret_time", "taint_time") < F.col("src_time"), F.lit(False))
    used = (
        edges(records.where("kind <> 'Verdict'")).where("type in ('Use', 'Require')").join(known, ["log_id", "dst"]).join(states, ["log_id", "dst"], "left")
        .groupBy("log_id", F.col("src").alias("id")).agg(F.max(F.when(usable, F.col("its")).otherwise(len(EVIDENCE) - 1)).alias("used"))
    )
    derived = F.greatest("base", F.coalesce("used", F.lit(0)))
    return subjects.join(used, ["log_id", "id"], "left").where(derived != F.col("stored")).select("log_id", "pos", "id")


def log_heads(records: DataFrame) -> DataFrame:
    """Per log: ``n`` records, ``accepted``, ``retracted`` and ``tainted`` counts by the stored verdicts."""
    judged = ledger(records)
    counts = judged.groupBy("log_id").agg(
        F.count_if("accepted").alias("accepted"), F.count_if(F.col("ret_time").isNotNull()).alias("retracted"), F.count_if(F.col("taint_time").isNotNull()).alias("tainted")
    )
    return records.groupBy("log_id").agg(F.count("*").alias("n"), F.max("time").alias("last_time")).join(counts, "log_id", "left")


def verify_logs(records: DataFrame, rules: Rules, dialect: Dialect) -> DataFrame:
    """Exact verdict of every log: ``log_id``, ``result``, ``reason``, ``checked``.

    A log is replayed in sequence within one task; the bound on a log file (64
    MiB) bounds the task.  Logs are replayed in parallel.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        verdict = replay(_records(pdf), rules, dialect)
        return pd.DataFrame([(pdf["log_id"].iloc[0], "Accept" if verdict.accepted else "Reject", verdict.reason, verdict.checked)], columns=["log_id", "result", "reason", "checked"])

    return records.groupBy("log_id").applyInPandas(run, "log_id string, result string, reason string, checked bigint")


def _records(pdf: pd.DataFrame) -> list[Record]:
    return [Record.from_row(r) for r in pdf.sort_values("pos").itertuples(index=False)]


def judge_logs(records: DataFrame, rules: DataFrame, dialect: Dialect) -> DataFrame:
    """Every record but verdicts, judged after those before it in its log, whatever its stored verdict.

    ``rules`` has ``log_id`` and ``rules_json``.  Returns ``log_id``, ``pos``,
    ``id``, ``kind``, ``result``, ``reason`` and the stored verdict's
    ``stored_result`` and ``stored_reason`` (null without one).  A log is judged in
    one task, many in parallel; a log without rules has no rows.
    """
    names = ["log_id", "pos", "id", "kind", "result", "reason", "stored_result", "stored_reason"]

    def run(log: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if log.empty or own.empty:
            return pd.DataFrame([], columns=names)
        ledger, out, stored = Ledger(Rules.read(loads(own["rules_json"].iloc[0].encode())), dialect), [], {}
        found = _records(log)
        for r in found:
            if r.kind == "Verdict" and r.refs:
                told = payload(r, dialect) or {}
                stored.setdefault(r.refs[0][1], (told.get("result"), told.get("reason")))
        for pos, r in zip(sorted(log["pos"]), found):
            if r.kind != "Verdict":
                reason = ledger.judge(r)
                ledger.admit(r)
                if reason is None:
                    ledger.fold(r)
                out.append((log["log_id"].iloc[0], pos, r.id, r.kind, "Reject" if reason else "Accept", reason, *stored.get(r.id, (None, None))))
            else:
                ledger.admit(r)
        return pd.DataFrame(out, columns=names)

    schema = "log_id string, pos bigint, id binary, kind string, result string, reason string, stored_result string, stored_reason string"
    return records.groupBy("log_id").cogroup(rules.groupBy("log_id")).applyInPandas(run, schema)
