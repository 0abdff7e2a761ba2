"""Driver tables seen as ledgers, and the ledger operators as named queries.

A stand-in that SQL can check: one log a customer, whose n-th order continues
order n div 2; lineitems are evaluations, and an order with lineitems has one
selection.  It has no signatures, payload bytes or rejected records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import graph, lineage, slots


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Candidates and selections of the projection."""
    orders = _read(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    numbered = orders.select(F.col("o_custkey").alias("log_id"), F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority", n.alias("n"))
    # Order n div 2 of the same log, by an equi-join: one key holds one order.
    older = numbered.select(F.col("log_id").alias("l"), F.col("n").alias("half"), F.col("id").alias("parent_order"))
    cand = numbered.join(older, (F.col("log_id") == F.col("l")) & (F.floor(F.col("n") / 2) == F.col("half")), "left").drop("l", "half")
    bad = (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.10)
    evals = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_discount").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count("*").alias("n_eval"), F.count_if(bad).alias("n_ret")
    )
    sel = cand.join(evals, "id").select(
        "log_id", "id", F.col("id").alias("candidate"), F.col("n").alias("time"), F.col("o_orderpriority").alias("objective"), "n_eval", "n_ret",
        (F.col("n_ret") > 0).alias("unsound"),
        ((F.col("n_ret") > 0) & (F.col("o_orderstatus") == "P") & (F.col("n_eval") > F.col("n_ret"))).alias("restored"),
        F.lit(True).alias("chosen"),
    )
    own = sel.select(F.col("log_id").alias("l"), F.col("id").alias("anchor"))
    anchored = cand.alias("c").join(own, F.expr("c.log_id = l and parent_order = anchor"), "left").drop("l")
    candidates = anchored.select(
        "log_id", "id", F.col("n").alias("time"), F.when(F.col("anchor").isNull(), "Root").otherwise("Continuation").alias("basis"),
        F.col("anchor").alias("parent"), "anchor", "parent_order",
    )
    return candidates, sel


def q_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, sel = lines(spark, sf_dir)
    # A continuation follows its parent order even where that has no selection of its own.
    follow = candidates.withColumns({"anchor": F.col("parent_order"), "parent": F.col("parent_order")})
    return lineage.frontier(follow, sel)


def q_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, _ = lines(spark, sf_dir)
    causes = candidates.where("anchor is not null").select("log_id", F.col("id").alias("src"), F.col("anchor").alias("dst"))
    return lineage.siblings(candidates, causes)


def q_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.selected(lines(spark, sf_dir)[1], "1-URGENT")


def q_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations that each selection used, summed up."""
    return lines(spark, sf_dir)[1].select("log_id", "id", "n_eval", "n_ret", "unsound")


def q_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, sel = lines(spark, sf_dir)
    restored = sel.where("restored").select("log_id", "id", "candidate")
    none = candidates.where(F.lit(False))
    bad = lineage.compromised(candidates, sel, none.select("log_id", F.col("id").alias("src"), F.col("id").alias("dst")), restored, none.select("log_id", "id"))
    known = bad.withColumn("bad", F.lit(True))
    return candidates.join(known, ["log_id", "id"], "left").select("log_id", "id", "basis", F.when(F.col("bad"), "compromised").otherwise("sound").alias("standing"))


def q_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsound selections with the one that restores them, along a chain of replacements."""
    _, sel = lines(spark, sf_dir)
    first = sel.select("log_id", "id", "unsound", F.lit(None).cast("bigint").alias("replaces"))
    again = sel.where("restored").select("log_id", (-1 - F.col("id")).alias("id"), F.lit(False).alias("unsound"), F.col("id").alias("replaces"))
    return lineage.restorations(first.unionAll(again))


def _starts(candidates: DataFrame) -> DataFrame:
    return candidates.where("time > 8").select("log_id", F.col("id").alias("start"))


def q_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, _ = lines(spark, sf_dir)
    # Selections have ids of their own: here the negative of their order's.
    apart = candidates.withColumn("anchor", -1 - F.col("anchor"))
    none = candidates.where(F.lit(False)).select("log_id", F.col("id").alias("src"), F.col("id").alias("dst"))
    return lineage.descent(apart, none, _starts(candidates)).select("log_id", "start", "node", "via", "level")


def q_descent_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descent of every candidate, with each node's place in the queue's order."""
    candidates, _ = lines(spark, sf_dir)
    apart = candidates.withColumn("anchor", -1 - F.col("anchor"))
    none = candidates.where(F.lit(False)).select("log_id", F.col("id").alias("src"), F.col("id").alias("dst"))
    found = lineage.descent(apart, none, candidates.select("log_id", F.col("id").alias("start")))
    place = F.row_number().over(Window.partitionBy("log_id", "start").orderBy("level", "rank"))
    return found.select("log_id", "start", "node", "via", "level", place.cast("bigint").alias("place"))


def q_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, _ = lines(spark, sf_dir)
    apart = candidates.withColumn("anchor", -1 - F.col("anchor"))
    none = candidates.where(F.lit(False)).select("log_id", F.col("id").alias("src"), F.col("id").alias("dst"))
    roots = candidates.where("time = 1").select("log_id", F.col("id").alias("node"))
    return lineage.descendants(apart, none, roots).select("log_id", "id", "level")


def q_taint_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, sel = lines(spark, sf_dir)
    flags = sel.select("log_id", "id", (F.col("n_ret") > 0).alias("bad"))
    records = candidates.join(flags, ["log_id", "id"], "left").select("log_id", "id", "time", F.when(F.col("bad"), F.col("time") + 4).alias("ret_time"))
    uses = candidates.where("parent is not null").select("log_id", F.col("id").alias("src"), F.col("parent").alias("dst"))
    return graph.taint_times(records, uses).select("log_id", "id", F.col("taint_time").cast("bigint").alias("taint_time"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")


def q_open_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view opens an action of its user, a click closes one."""
    kind = F.col("event_type")
    found = slots.open_before(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], kind == "view", kind == "click", "open_before")
    return found.select("event_id", "user_id", F.col("open_before").cast("bigint").alias("open_before"))


def q_response_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = slots.turns(_events(spark, sf_dir).where("event_type = 'purchase'"), ["user_id"], ["ts", "event_id"])
    return found.select("event_id", "user_id", F.col("turn_index").cast("bigint").alias("turn_index"))


def q_usage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "not_done").otherwise("no_change")
    return slots.usage_counts(_events(spark, sf_dir).withColumn("outcome", outcome), ["user_id"], "outcome")


def q_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = _events(spark, sf_dir).where("event_type <> 'error'")
    return slots.context(live, "user_id", "ts", "event_id", 20).select("user_id", "event_id", F.col("rank").cast("bigint").alias("rank"))


def q_capability_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capability slot of a user just before each view: the last signup, gone after an error."""
    kind = F.col("event_type")
    value = F.when(kind == "signup", F.col("event_id")).when(kind == "error", F.lit(-1))
    found = slots.last_before(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], value, "slot")
    return found.where("event_type = 'view'").select("event_id", "user_id", F.nullif("slot", F.lit(-1)).alias("slot"))


def q_gap_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.gap_free(_read(spark, sf_dir, "conversations", "conv_id", "turn"), "conv_id", "turn")


def q_record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", F.sha2(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")), 256).alias("id"))


def q_head_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _read(spark, sf_dir, "orders", "o_custkey", "o_orderkey").withColumn("id", F.unhex(F.sha2(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")), 256)))
    return slots.head_hashes(ids, "o_custkey", "o_orderkey", "id")


def q_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range scan by time, both ends included."""
    return _events(spark, sf_dir).where("event_id between 1000 and 2000").select("event_id", "user_id", "event_type")


def q_weakest_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weakest evidence among what an order uses; a returned line counts as assumed."""
    rank = F.when(F.col("l_returnflag") == "R", 4).when(F.col("l_linestatus") == "O", 2).otherwise(1)
    return _read(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus").groupBy("l_orderkey").agg(F.max(rank).alias("evidence"))


def q_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery claims: requirements of an order (its line statuses) without passing evaluation."""
    parts = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_linestatus", "l_returnflag")
    need = parts.select("l_orderkey", "l_linestatus").distinct()
    have = parts.where("l_returnflag <> 'R'").select("l_orderkey", "l_linestatus").distinct()
    missing = need.join(have, ["l_orderkey", "l_linestatus"], "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("missing"))
    failing = parts.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("failing"))
    base = need.groupBy("l_orderkey").agg(F.count("*").alias("required"))
    return base.join(missing, "l_orderkey", "left").join(failing, "l_orderkey", "left").select(
        "l_orderkey", "required", (F.coalesce("missing", F.lit(0)) == 0).alias("d1"), (F.coalesce("failing", F.lit(0)) == 0).alias("d2")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "frontier": q_frontier, "siblings": q_siblings, "selected": q_selected, "evidence_of_selection": q_evidence,
    "standing": q_standing, "restored": q_restored, "descent": q_descent, "descent_all": q_descent_all, "descendants": q_descendants,
    "taint_times": q_taint_times, "open_actions_asof": q_open_actions, "response_turns": q_response_turns,
    "usage_counts": q_usage_counts, "context_topk": q_context, "capability_asof": q_capability_asof, "gap_free": q_gap_free,
    "record_id_hash": q_record_ids, "head_hash": q_head_hash, "range_scan": q_scan, "weakest_evidence": q_weakest_evidence,
    "delivery_claims": q_delivery,
}

_LINES = """
ord as (select o_custkey log_id, o_orderkey k, o_orderstatus st, o_orderpriority objective,
          row_number() over (partition by o_custkey order by o_orderkey) n from orders),
cand as (select c.log_id, c.k, c.n, c.objective, c.st, p.k par from ord c left join ord p on c.log_id = p.log_id and p.n = c.n // 2 and c.n > 1),
evk as (select l_orderkey k, count(*) n_eval, sum(case when l_returnflag = 'R' and l_discount >= 0.10 then 1 else 0 end)::bigint n_ret from lineitem group by l_orderkey),
sel as (select c.log_id, c.k, c.n, c.objective, e.n_eval, e.n_ret, e.n_ret > 0 unsound, (e.n_ret > 0 and c.st = 'P' and e.n_eval > e.n_ret) restored
        from cand c join evk e on c.k = e.k),
node as (select c.log_id, c.k, c.n, case when s.k is null then null else c.par end parent, coalesce(s.unsound and not s.restored, false) bad
         from cand c left join sel s on s.k = c.par)
"""

ORACLE_SQL: dict[str, str] = {
    "frontier": f"""with {_LINES}
select log_id, k as id, case when not exists (select 1 from sel s where s.k = c.k) then 'unconsidered' else 'selected-no-continuation' end as state
from cand c where not exists (select 1 from sel s where s.k = c.k) or not exists (select 1 from cand d where d.par = c.k)""",
    "siblings": f"with {_LINES} select a.log_id, a.k as id, b.k as sibling from node a join node b on a.log_id = b.log_id and a.parent = b.parent and a.k <> b.k",
    "selected": f"with {_LINES} select log_id, n as time, k as id, k as candidate, unsound from sel where objective = '1-URGENT'",
    "evidence_of_selection": f"with {_LINES} select log_id, k as id, n_eval, n_ret, unsound from sel",
    "standing": f"""with recursive {_LINES},
comp as (select log_id, k from node where bad union select d.log_id, d.k from node d join comp c on d.parent = c.k)
select log_id, k as id, case when parent is null then 'Root' else 'Continuation' end as basis,
  case when k in (select k from comp) then 'compromised' else 'sound' end as standing from node""",
    "restored": f"with {_LINES} select log_id, k as id, -1 - k as by from sel where restored",
    "descent": f"""with recursive {_LINES},
back as (select log_id, k src, -1 - parent dst, 'continuation-anchor' via from node where parent is not null
         union all select log_id, k, parent, 'parent' from node where parent is not null),
walk as (select log_id, k as start, k as node, '' as via, 0 as level from node where n > 8
         union select w.log_id, w.start, b.dst, b.via, w.level + 1 from walk w join back b on w.log_id = b.log_id and w.node = b.src)
select log_id, start, node, via, level from walk where level > 0""",
    "descent_all": f"""with recursive {_LINES},
back as (select log_id, k src, -1 - parent dst, 'continuation-anchor' via from node where parent is not null
         union all select log_id, k, parent, 'parent' from node where parent is not null),
walk as (select log_id, k as start, k as node, '' as via, 0 as level from node
         union select w.log_id, w.start, b.dst, b.via, w.level + 1 from walk w join back b on w.log_id = b.log_id and w.node = b.src)
select log_id, start, node, via, level, row_number() over (partition by log_id, start order by level, via) as place from walk where level > 0""",
    "descendants": f"""with recursive {_LINES},
fwd as (select log_id, parent src, k dst from node where parent is not null),
walk as (select log_id, k as id, 0 as level from node where n = 1
         union select w.log_id, f.dst, w.level + 1 from walk w join fwd f on w.log_id = f.log_id and w.id = f.src)
select log_id, id, level from walk where level > 0""",
    "taint_times": f"""with recursive {_LINES},
own as (select n.log_id, n.k, n.n, n.parent, case when s.n_ret > 0 then n.n + 4 end ret from node n left join sel s on s.k = n.k),
walk as (select c.log_id, c.k, c.n, greatest(c.n, p.ret) t from own c join own p on c.parent = p.k where p.ret is not null
         union select c.log_id, c.k, c.n, greatest(c.n, w.t) from own c join walk w on c.parent = w.k)
select log_id, k as id, min(t)::bigint as taint_time from walk group by log_id, k""",
    "open_actions_asof": """select event_id, user_id, coalesce(sum(case event_type when 'view' then 1 when 'click' then -1 else 0 end)
over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0)::bigint as open_before from events""",
    "response_turns": "select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as turn_index from events where event_type = 'purchase'",
    "usage_counts": """select user_id, count(*) filter (event_type = 'purchase') as done, count(*) filter (event_type = 'error') as not_done,
count(*) filter (event_type not in ('purchase', 'error')) as no_change from events group by user_id""",
    "context_topk": """select user_id, event_id, rank from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id) as rank
from events where event_type <> 'error') where rank <= 20""",
    "capability_asof": """select event_id, user_id, nullif(slot, -1) as slot from (select event_id, user_id, event_type,
last_value(case event_type when 'signup' then event_id when 'error' then -1 end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as slot
from events) where event_type = 'view'""",
    "gap_free": """select conv_id, count(*) as n, coalesce(bool_and(step = 1), true) as gap_free from (select conv_id, turn - lag(turn) over (partition by conv_id order by turn) as step from conversations) group by conv_id""",
    "record_id_hash": "select o_orderkey, sha256('order:' || o_orderkey) as id from orders",
    "head_hash": """select o_custkey, sha256(unhex(string_agg(sha256('order:' || o_orderkey), '' order by o_orderkey))) as head_hash, count(*) as n from orders group by o_custkey""",
    "range_scan": "select event_id, user_id, event_type from events where event_id between 1000 and 2000",
    "weakest_evidence": "select l_orderkey, max(case when l_returnflag = 'R' then 4 when l_linestatus = 'O' then 2 else 1 end) as evidence from lineitem group by l_orderkey",
    "delivery_claims": """select l_orderkey, count(*) as required, bool_and(have > 0) as d1, sum(failing) = 0 as d2 from (
select l_orderkey, l_linestatus, count(*) filter (l_returnflag <> 'R') as have, count(*) filter (l_returnflag = 'R') as failing from lineitem group by 1, 2) group by l_orderkey""",
}
