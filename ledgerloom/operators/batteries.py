"""The rules of a record as relations: what each rule finds, and the first of them.

Every rule emits the records that it fails: ``log_id``, ``id``, ``ord`` (its place
among the rules) and ``reason``; the least ``ord`` of a record gives its verdict.
As in :mod:`ledgerloom.operators.relational`, stored verdicts are taken as right
and the state before a record is derived from them, so all records of all logs
are judged at once, with joins on ``log_id`` and no log in one task.

Byte-exact rules (ids, signatures, canonical payloads) work on one record at a
time and run in Arrow batches; all others are joins and windows.  Covered are the
rules common to all kinds and those of requests, responses, retractions,
requirements, candidates and evaluations (:data:`COVERED`); the other kinds are
judged in sequence by ``judge_logs``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.canonical import CanonicalError
from ledgerloom.functions.records import Record
from ledgerloom.functions.schemas import AUTHORS, DIGESTS, EVIDENCE, REPLACEABLE, Dialect, is_canonical
from ledgerloom.operators.relational import _field, _hash, _rank, edges, evidence_failures, ledger, reference_failures
from ledgerloom.plans import materialize

COVERED = ("Request", "Response", "Retraction", "Requirement", "Candidate", "Evaluation")
_RULES = (
    "space array<int>, kind_schema_map array<array<string>>, signature_required_kinds array<string>, author_keys map<string,string>, "
    "author_roles map<string,string>, admin_retraction_actors array<string>, evidence_thresholds map<string,string>, reject_compromised_continuation boolean"
)
_ARTIFACTS = "array<struct<scheme:string,digest:string,name:string>>"
# Places of rules; those of a kind begin behind all common ones.
IDENTITY, ORDER, SPACE, SCHEMA, KIND, ROLE, SIGNED, SIGNATURE, REFERENCES, REPLACES, EVIDENCE_AT, FLOOR, CANONICAL, OWN = range(0, 1400, 100)


def _bytes32(numbers: Column) -> Column:
    return F.unhex(F.array_join(F.transform(numbers, lambda b: F.lpad(F.hex(b), 2, "0")), ""))


def rule_rows(rules: DataFrame) -> DataFrame:
    """``log_id`` and the rules' fields, from ``rules_json``."""
    r = F.from_json("rules_json", _RULES)
    kinds = F.transform(r["kind_schema_map"], lambda p: F.struct(_bytes32(F.from_json(p[0], "array<int>")).alias("schema"), p[1].alias("kind")))
    return rules.select(
        "log_id", _bytes32(r["space"]).alias("r_space"), F.map_from_entries(kinds).alias("r_kinds"), r["signature_required_kinds"].alias("r_signed"),
        F.map_keys(r["author_keys"]).alias("r_pinned"), r["author_roles"].alias("r_roles"), r["admin_retraction_actors"].alias("r_admins"),
        r["evidence_thresholds"].alias("r_floors"), r["reject_compromised_continuation"].alias("r_strict"),
    )


def _fails(rows: DataFrame, where: Column, place: int | Column, reason: str) -> DataFrame:
    """Records for which a rule does not hold; what is unknown does not hold either."""
    place = F.lit(place) if isinstance(place, int) else place
    return rows.where(where).select("log_id", "id", place.cast("bigint").alias("ord"), F.lit(reason).alias("reason"))


def _not(holds: Column) -> Column:
    return ~F.coalesce(holds, F.lit(False))


def exact_failures(records: DataFrame, rules: DataFrame, dialect: Dialect) -> DataFrame:
    """Wrong ids and signatures, and payloads that are not the canonical bytes of their schema."""
    keys = rules.select("log_id", F.from_json("rules_json", "author_keys map<string,array<array<int>>>")["author_keys"].alias("keys"))
    rows = records.where("kind <> 'Verdict'").join(keys, "log_id")
    pinned = F.transform(F.element_at("keys", F.col("author")), _bytes32)
    columns = ["log_id", *(c for c in records.columns if c not in ("log_id", "pos"))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                r = Record.from_row(row)
                try:
                    same = r.computed_id() == r.id
                except CanonicalError:
                    same = False
                if not same:
                    out.append((row.log_id, r.id, IDENTITY, "InvalidPayload"))
                if r.signature is not None:
                    key = r.verified_key(dialect)
                    if key is None or row.pinned is not None and key not in {bytes(k) for k in row.pinned}:
                        out.append((row.log_id, r.id, SIGNATURE, "SignatureInvalid"))
                name = dialect.name(r.schema)
                if name is None or not is_canonical(name, r.data):
                    out.append((row.log_id, r.id, CANONICAL, "UnknownSchema" if name is None else "InvalidPayload"))
            yield pd.DataFrame(out, columns=["log_id", "id", "ord", "reason"])

    return rows.select(*columns, pinned.alias("pinned")).mapInPandas(run, "log_id string, id binary, ord bigint, reason string")


def common_failures(records: DataFrame, judged: DataFrame, rules: DataFrame, dialect: Dialect) -> DataFrame:
    """Rules that hold for every kind, but for the byte-exact ones."""
    rows = judged.join(rule_rows(rules), "log_id")
    may = F.create_map(*(x for k, types in AUTHORS.items() for x in (F.lit(k), F.array(*map(F.lit, types)))))
    own = F.element_at("r_kinds", F.col("schema"))
    need = F.array_contains("r_signed", F.col("kind")) | F.array_contains("r_pinned", F.col("author"))
    floor = F.element_at("r_floors", F.col("kind"))
    found = [
        _fails(rows, _not(F.col("space") == F.col("r_space")), SPACE, "InvalidPayload"),
        _fails(rows, own.isNull(), SCHEMA, "UnknownSchema"),
        _fails(rows, _not(own == F.col("kind")), KIND, "KindSchemaMismatch"),
        _fails(rows, _not(F.array_contains(F.element_at(may, F.col("kind")), F.col("author_type"))), ROLE, "AuthorRoleInvalid"),
        _fails(rows, _not(F.element_at("r_roles", F.col("author")) == F.col("author_type")), ROLE + 1, "AuthorRoleInvalid"),
        _fails(rows, F.col("signature").isNull() & F.coalesce(need, F.lit(False)), SIGNED, "SignatureMissing"),
        _fails(rows, floor.isNotNull() & (_rank(F.col("evidence"), EVIDENCE) > _rank(floor, EVIDENCE)), FLOOR, "EvidenceBelowThreshold"),
    ]
    refs = reference_failures(records, judged)
    place = F.when(F.col("reason") == "InvalidPayload", ORDER).otherwise(REFERENCES).cast("bigint")
    found.append(refs.select("log_id", "id", place.alias("ord"), "reason"))
    found.append(evidence_failures(records, judged, dialect).select("log_id", "id", F.lit(EVIDENCE_AT).cast("bigint").alias("ord"), F.lit("InvalidPayload").alias("reason")))
    old = _targets(judged)
    replaced = _refs(rows, old).where("type = 'Replace'")
    many = replaced.groupBy("log_id", "id").agg(F.count("*").alias("n"))
    found.append(_fails(many, F.col("n") > 1, REPLACES, "InvalidPayload"))
    fits = F.col("kind").isin(*REPLACEABLE) & F.col("x_accepted") & (F.col("x_kind") == F.col("kind"))
    found.append(_fails(replaced, _not(fits), REPLACES + 1, "ReplacementInvalid"))
    return reduce(DataFrame.unionAll, found)


def _targets(judged: DataFrame) -> DataFrame:
    """Records as targets of references, columns ``x_*``."""
    gone = F.least("ret_time", "taint_time").alias("x_gone")
    return judged.select("log_id", F.col("id").alias("x"), *(F.col(c).alias(f"x_{c}") for c in ("kind", "thread", "space", "author", "accepted", "time", "data")), gone)


def _refs(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """References of records with their targets; a target that is not there has null columns."""
    each = rows.select("*", F.posexplode("refs").alias("place", "ref")).withColumns({"type": F.col("ref.type"), "x": F.col("ref.target")})
    return each.join(targets, ["log_id", "x"], "left")


def _pointed(rows: DataFrame, targets: DataFrame, x: Column) -> DataFrame:
    """Records with the earlier record that a payload field names, columns ``x_*``."""
    earlier = F.col("x_time") < F.col("time")
    joined = rows.withColumn("x", x).join(targets, ["log_id", "x"], "left")
    hidden = {c: F.when(earlier, F.col(c)) for c in joined.columns if c.startswith("x_") and c != "x_time"}
    return joined.withColumns(hidden)


def _causes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("causes", F.transform(F.filter("refs", lambda r: r["type"] == "Cause"), lambda r: r["target"]))


def _near() -> Column:
    return (F.col("x_thread") == F.col("thread")) & (F.col("x_space") == F.col("space"))


def request_failures(rows: DataFrame, targets: DataFrame) -> DataFrame:
    mine = _causes(rows.where("kind = 'Request'").withColumn("parent", _hash("parent_request_id")))
    refs = _refs(mine, targets).where("type = 'Cause'")
    place = F.lit(OWN) + F.col("place") * 3
    alone = F.when(F.col("parent").isNull(), F.size("causes") == 0).otherwise((F.size("causes") == 1) & (F.get("causes", F.lit(0)) == F.col("parent")))
    return reduce(DataFrame.unionAll, [
        _fails(refs, _not(F.col("x_kind") == "Request"), place, "InvalidPayload"),
        _fails(refs, _not(F.col("x_thread") == F.col("thread")), place + 1, "InvalidPayload"),
        _fails(refs, _not(F.col("x_accepted")), place + 2, "RequestMissing"),
        _fails(mine, _not(alone), OWN + 99_999, "InvalidPayload"),
    ])


def _ends(judged: DataFrame) -> DataFrame:
    """When requests end: by a closing response or a refusal."""
    kept = judged.where("accepted")
    closing = kept.where((F.col("kind") == "Response") & (_field("closes_request") == "true")).select("log_id", _hash("request_id").alias("x"), "time")
    refused = kept.where((F.col("kind") == "Refusal") & (_field("target_kind") == "Request")).select("log_id", _hash("target_id").alias("x"), "time")
    return closing.unionAll(refused).groupBy("log_id", "x").agg(F.min("time").alias("end"))


def response_failures(rows: DataFrame, judged: DataFrame, targets: DataFrame) -> DataFrame:
    mine = _pointed(rows.where("kind = 'Response'"), targets, _hash("request_id")).join(_ends(judged), ["log_id", "x"], "left")
    live = (F.col("x_kind") == "Request") & F.col("x_accepted") & _near() & (F.col("end").isNull() | (F.col("end") >= F.col("time")))
    kept = judged.where("accepted")
    one = mine.select("log_id", "id", "x", "time")
    turns = kept.where("kind = 'Response'").select("log_id", _hash("request_id").alias("x"), F.col("time").alias("at"))
    counted = one.join(turns, ["log_id", "x"]).where("at < time").groupBy("log_id", "id").agg(F.count("*").alias("turns"))
    done = kept.where("kind = 'Result'").select("log_id", _hash("action_id").alias("action"), "time").unionAll(
        kept.where((F.col("kind") == "Refusal") & (_field("target_kind") == "Action")).select("log_id", _hash("target_id").alias("action"), "time")
    ).groupBy("log_id", "action").agg(F.min("time").alias("done"))
    actions = kept.where("kind = 'Action'").select("log_id", F.col("id").alias("action"), _hash("request_id").alias("x"), F.col("time").alias("at")).join(done, ["log_id", "action"], "left")
    open_ = one.join(actions, ["log_id", "x"]).where("at < time and (done is null or done >= time)").select("log_id", "id", F.lit(True).alias("open")).distinct()
    plans = kept.where("kind = 'Plan'").select("log_id", _hash("request_id").alias("x"), F.col("time").alias("at"), _field("status").alias("status"))
    last = one.join(plans, ["log_id", "x"]).where("at < time").groupBy("log_id", "id").agg(F.max_by("status", "at").alias("plan"))
    whole = mine.join(counted, ["log_id", "id"], "left").join(open_, ["log_id", "id"], "left").join(last, ["log_id", "id"], "left")
    busy = F.coalesce(F.col("open"), F.lit(False)) | F.coalesce(F.col("plan") == "running", F.lit(False))
    return reduce(DataFrame.unionAll, [
        _fails(whole, _not(live), OWN, "RequestMissing"),
        _fails(whole, _not(_field("turn_index").cast("bigint") == F.coalesce("turns", F.lit(0))), OWN + 1, "InvalidPayload"),
        _fails(whole, (_field("closes_request") == "true") & busy, OWN + 2, "InvalidPayload"),
    ])


def retraction_failures(rows: DataFrame, targets: DataFrame) -> DataFrame:
    mine = _pointed(_causes(rows.where("kind = 'Retraction'")), targets, _hash("target_id"))
    may = (F.col("author") == F.col("x_author")) | F.array_contains("r_admins", F.col("author"))
    return reduce(DataFrame.unionAll, [
        _fails(mine, _not((F.size("causes") == 1) & (F.get("causes", F.lit(0)) == F.col("x"))), OWN, "InvalidPayload"),
        # A verdict is no target here, as it has none of the targets' columns.
        _fails(mine, _not(F.col("x_accepted") & (F.col("x_kind") != "Retraction")), OWN + 1, "InvalidPayload"),
        _fails(mine, _not(may), OWN + 2, "AuthorRoleInvalid"),
    ])


def requirement_failures(rows: DataFrame, judged: DataFrame, targets: DataFrame) -> DataFrame:
    key = _field("key")
    mine = _causes(rows.where("kind = 'Requirement'")).withColumn("request", F.get("causes", F.lit(0)))
    writers = F.when(_field("provenance") == "user_authored", F.col("author_type") == "User").otherwise(F.col("author_type").isin("Provider", "System"))
    asked = _pointed(mine, targets, F.col("request"))
    cause = (F.col("x_kind") == "Request") & F.col("x_accepted") & _near()
    # A key is held from its requirement on until a retraction of one that had it.
    kept = _causes(judged.where("accepted and kind = 'Requirement'")).select("log_id", "id", "time", key.alias("key"), F.get("causes", F.lit(0)).alias("request"))
    gone = judged.where("accepted and kind = 'Retraction'").select("log_id", _hash("target_id").alias("id"), F.col("time").alias("at"))
    events = kept.select("log_id", "request", "key", F.col("time").alias("at"), F.lit(True).alias("held")).unionAll(
        kept.join(gone, ["log_id", "id"]).select("log_id", "request", "key", "at", F.lit(False))
    )
    told = mine.select("log_id", "id", "time", "request", key.alias("key")).join(events, ["log_id", "request", "key"]).where("at < time")
    held = told.groupBy("log_id", "id").agg(F.max_by("held", "at").alias("held"))
    return reduce(DataFrame.unionAll, [
        _fails(mine, _not((key != "") & (_field("description") != "")), OWN, "RequirementInvalid"),
        _fails(mine, _not(writers), OWN + 1, "AuthorRoleInvalid"),
        _fails(mine, F.size("causes") != 1, OWN + 2, "RequirementInvalid"),
        _fails(asked, _not(cause), OWN + 3, "RequirementInvalid"),
        _fails(held, F.col("held"), OWN + 4, "RequirementInvalid"),
    ])


def artifacts_hold(json: Column) -> Column:
    """Whether an artifact list is null, or well-formed and strictly ascending."""
    found = F.from_json(json, _ARTIFACTS)
    sizes = F.create_map(*(x for k, n in DIGESTS.items() for x in (F.lit(k), F.lit(2 * n))))

    def one(a: Column) -> Column:
        n = F.length(a["digest"])
        fits = F.when(F.element_at(sizes, a["scheme"]).isNotNull(), n == F.element_at(sizes, a["scheme"])).otherwise(n.between(40, 128))
        return F.rlike(a["scheme"], F.lit(r"\A[a-z0-9][a-z0-9.-]*\z")) & F.rlike(a["digest"], F.lit(r"\A(?:[0-9a-f]{2})+\z")) & fits

    at = lambda i: F.get(found, i)  # noqa: E731  a missing name stands before any
    ascending = F.forall(F.sequence(F.lit(0), F.size(found) - 1), lambda i: (i == 0) | (at(i - 1) < at(i)))
    return json.isNull() | ((F.size(found) == 0) | (F.forall(found, one) & ascending))


def candidate_failures(rows: DataFrame, targets: DataFrame) -> DataFrame:
    mine = _pointed(_causes(rows.where("kind = 'Candidate'").withColumn("basis", _field("basis"))), targets, _hash("parent"))
    size = F.when(_field("source.git.algo") == "sha1", 40).otherwise(64)
    hexed = lambda c: (F.length(c) == size) & F.rlike(c, F.lit(r"\A[0-9a-f]*\z"))
    commit = _field("source.git.commit")
    bound = (_field("source.manifest_hash").isNotNull()) == (_field("source.binding") == "manifest")
    source = hexed(_field("source.git.tree")) & (commit.isNull() | hexed(commit)) & bound
    parent = F.col("x").isNull() | ((F.col("x_kind") == "Candidate") & F.col("x_accepted") & (F.col("x_space") == F.col("space")))
    refs = _refs(rows.where("kind = 'Candidate'"), targets).where("type = 'Cause'")
    kinds = refs.groupBy("log_id", "id").agg(
        F.collect_set("x_kind").alias("kinds"), F.bool_and(F.coalesce("x_accepted", F.lit(False))).alias("kept"),
        F.max(F.col("x_gone") < F.col("time")).alias("spoilt"), F.max(F.get_json_object(F.decode("x_data", "utf-8"), "$.outcome.selected.candidates")).alias("picked"),
    )
    whole = mine.join(kinds, ["log_id", "id"], "left").withColumns({"kinds": F.coalesce("kinds", F.array().cast("array<string>")), "kept": F.coalesce("kept", F.lit(True))})
    only = lambda *names: F.size(F.array_except("kinds", F.array(*map(F.lit, names)))) == 0
    root = F.col("x").isNull() & (F.size("causes") < 2) & F.col("kept") & only("Request")
    derived = F.col("x").isNull() & (F.size("causes") > 0) & F.col("kept")
    follows = (F.size("causes") == 1) & only("Selection") & F.col("kept")
    sound = ~F.col("r_strict") | ~F.coalesce("spoilt", F.lit(False))
    picked = F.transform(F.from_json("picked", "array<array<int>>"), _bytes32)
    is_ = lambda name: F.col("basis") == name
    return reduce(DataFrame.unionAll, [
        _fails(mine, _not(source), OWN, "SourceBindingInvalid"),
        _fails(mine, _not(artifacts_hold(_field("artifacts"))), OWN + 1, "ArtifactRefInvalid"),
        _fails(mine, _not(parent), OWN + 2, "PayloadRefUnresolved"),
        _fails(whole, is_("root") & _not(root), OWN + 3, "LineageInvalid"),
        _fails(whole, is_("derivation") & _not(derived & only("Candidate", "Evaluation")), OWN + 3, "LineageInvalid"),
        _fails(whole, is_("continuation") & _not(follows & sound & F.array_contains(picked, F.col("x"))), OWN + 3, "LineageInvalid"),
    ])


def evaluation_failures(rows: DataFrame, targets: DataFrame, dialect: Dialect) -> DataFrame:
    mine = _pointed(rows.where("kind = 'Evaluation'"), targets, _hash("candidate"))
    attested = F.col("schema") == F.lit(dialect.schema_id("evaluation.attested.v1"))
    full = _field("evaluator").isNotNull()
    used = F.transform(F.filter("refs", lambda r: r["type"] == "Use"), lambda r: r["target"])
    named = (F.col("x_kind") == "Candidate") & F.col("x_accepted") & (F.col("x_space") == F.col("space"))
    needs = F.transform(F.from_json(_field("requirements"), "array<array<int>>"), _bytes32)
    mine = mine.withColumns({"needs": needs, "used": used, "subject": F.col("x")})
    ascending = F.forall(F.sequence(F.lit(0), F.size("needs") - 1), lambda i: (i == 0) | (F.get("needs", i - 1) < F.get("needs", i)))
    plain = mine.select(*(c for c in mine.columns if not c.startswith("x_") and c != "x"))
    each = plain.where(full).select("*", F.posexplode("needs").alias("n", "need"))
    each = _pointed(each, targets, F.col("need"))
    real = (F.col("x_kind") == "Requirement") & F.col("x_accepted") & (F.col("x_space") == F.col("space"))
    place = F.lit(OWN + 10) + F.col("n") * 2
    return reduce(DataFrame.unionAll, [
        _fails(mine, attested & F.col("signature").isNull(), OWN, "SignatureMissing"),
        _fails(mine, attested & _not(F.array_contains("r_pinned", F.col("author"))), OWN + 1, "SignatureInvalid"),
        _fails(mine, _not(named), OWN + 2, "PayloadRefUnresolved"),
        _fails(mine, _not(F.array_contains("used", F.col("subject"))), OWN + 3, "EvaluationInvalid"),
        _fails(mine, full & _not(_field("evaluator.id") != ""), OWN + 4, "EvaluationInvalid"),
        _fails(mine, full & _not(artifacts_hold(_field("evidence"))), OWN + 5, "ArtifactRefInvalid"),
        _fails(mine, full & (F.size("needs") > 1) & _not(ascending), OWN + 6, "EvaluationInvalid"),
        _fails(each, _not(real), place, "EvaluationInvalid"),
        _fails(each, _not(F.array_contains("used", F.col("need"))), place + 1, "EvaluationInvalid"),
    ])


def reasons(records: DataFrame, rules: DataFrame, dialect: Dialect) -> DataFrame:
    """``log_id``, ``pos``, ``id``, ``kind``, ``result`` and ``reason`` of all records of the kinds in COVERED.

    ``records`` is a table of records, ``rules`` has ``log_id`` and ``rules_json``.
    A log's records up to the first whose stored verdict differs are judged as a
    replay would; those behind it rest on stored verdicts.
    """
    judged = materialize(ledger(records), "judged")
    rows, targets = judged.join(rule_rows(rules), "log_id"), _targets(judged)
    found = [
        exact_failures(records, rules, dialect), common_failures(records, judged, rules, dialect), request_failures(rows, targets),
        response_failures(rows, judged, targets), retraction_failures(rows, targets), requirement_failures(rows, judged, targets),
        candidate_failures(rows, targets), evaluation_failures(rows, targets, dialect),
    ]
    first = reduce(DataFrame.unionAll, found).groupBy("log_id", "id").agg(F.min_by("reason", "ord").alias("why"))
    return (
        judged.where(F.col("kind").isin(*COVERED)).select("log_id", "pos", "id", "kind").join(first, ["log_id", "id"], "left")
        .select("log_id", "pos", "id", "kind", F.when(F.col("why").isNull(), "Accept").otherwise("Reject").alias("result"), F.col("why").alias("reason"))
    )
