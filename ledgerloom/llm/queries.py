"""The training-data operators as named queries, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.decontaminate import contaminated
from ledgerloom.llm.embed_dedup import near_duplicate_vectors
from ledgerloom.llm.html_extract import extract_text
from ledgerloom.llm.langid import identify
from ledgerloom.llm.mixing import mix_sources
from ledgerloom.llm.simhash import simhash_components
from ledgerloom.llm.substring import remove_repeated_words
from ledgerloom.llm.suffix import remove_repeats
from ledgerloom.llm.url_filter import filter_urls, rules_table
from ledgerloom.llm.warc import audit, leaves, warc_record

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under SimHash links."""
    return simhash_components(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item, with the item and the place."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose record is damaged in a replica of the archive.

    The replica's damage is a fixture: a page whose payload digest begins with
    0 has one byte more at its end there.
    """
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    whole = F.coalesce("html", F.lit(""))
    hurt = F.when(F.sha2(whole, 256).startswith("0"), F.concat(whole, F.lit("\n"))).otherwise(whole)
    first, second = (
        leaves(pages.select("page_id", "url", warc_record(F.col("url"), html).alias("record"), whole.alias("h")),
               "page_id", "record", F.concat_ws(" ", F.coalesce("url", F.lit("")), F.sha2("h", 256)))
        for html in (whole, hurt)
    )
    return audit(first, second).select(F.col("id").alias("page_id"), "begin", "end", "left_hash", "right_hash")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat an earlier document's."""
    cut = remove_repeated_words(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat an earlier document's."""
    cut = remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding within its label."""
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_warc_audit": op5_warc_audit,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_language_id": op9_language_id,
    "op10_html_extract": op10_html_extract,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": """
with cut as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
split as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from cut),
parts as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from split),
rules(rh, rp, rv) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                             ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit as (
  select host, path, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(rv, length(rh || rp)) as rv
  from (select distinct host, path from parts) join rules
    on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by host, path)
select page_id, p.host, p.path, rule, coalesce(rv, 'allow') as verdict from parts p left join fit f on p.host = f.host and p.path = f.path
""",
    "op4_decontamination": r"""
with item as (
  select row_number() over () as i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from benchmark where text is not null),
sized as (select i, item_id, w, least(len(w), 5) as k, len(w) - least(len(w), 5) + 1 as m from item where len(w) > 0),
item_gram as (
  select i, item_id, k, m, g, count(*) as c
  from (select i, item_id, k, m, array_to_string(w[p:p + k - 1], ' ') as g from sized, unnest(range(1, m + 1)) as t(p)) group by all),
doc as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents where text is not null),
doc_gram as (
  select r, k, len(w) - k + 1 as d, p - 1 as pos, array_to_string(w[p:p + k - 1], ' ') as g
  from doc, (select distinct k from sized), unnest(range(1, len(w) - k + 2)) as t(p)),
hit as (select r, i, item_id, k, m, c, d, least(m, d) as size, pos, g from doc_gram join item_gram using (k, g)),
inside as (
  select r, i, item_id, k, m, size, s, g, least(count(*), max(c)) as both_g
  from hit, unnest(range(greatest(0, pos - size + 1), least(pos, d - size) + 1)) as t(s) group by all),
scored as (select r, i, item_id, k, m, s, sum(both_g) as common, any_value(size) as size from inside group by r, i, item_id, k, m, s),
found as (
  select r, item_id, k, m, s, common / (m + size - common) as similarity from scored where common / (m + size - common) >= 0.8),
best as (
  select r, item_id, k, arg_max(struct_pack(sim := similarity, s := s, m := m), struct_pack(a := similarity, b := -s)) as b
  from found group by r, item_id, k)
select distinct doc_id, item_id, b.sim as similarity, cast(b.s as integer) as start, cast(b.m + k - 1 as integer) as n_words from best join doc using (r)
""",
    "op5_warc_audit": r"""
with rec as (
  select page_id, coalesce(url, '') as u, coalesce(html, '') as h, sha256(coalesce(html, '')) as d from pages),
full_rec as (
  select *, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u as head,
         chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' as mid,
         chr(13) || chr(10) || chr(13) || chr(10) as gap from rec),
both_rec as (
  select page_id, u, d, head || chr(13) || chr(10) || 'WARC-Block-Digest: sha256:' || d || mid || strlen(h) || gap || h || gap as a,
         head || chr(13) || chr(10) || 'WARC-Block-Digest: sha256:' || sha256(h || chr(10)) || mid || strlen(h || chr(10)) || gap || h || chr(10) || gap as b
  from full_rec),
placed as (
  select *, sum(strlen(a)) over (partition by floor(page_id / 4096.0) order by page_id, u || ' ' || d rows unbounded preceding) as stop from both_rec)
select page_id, cast(stop - strlen(a) as bigint) as begin, cast(stop as bigint) as "end", sha256(a) as left_hash, sha256(b) as right_hash
from placed where d like '0%'
""",
    "op6_substring_dedup": r"""
with texts as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
words as (select r, doc_id, p, w[p] as word, case when p + 49 <= len(w) then array_to_string(w[p:p + 49], ' ') end as win
          from texts, unnest(range(1, len(w) + 1)) as t(p)),
firsts as (select win, min(doc_id) as d from words where win is not null group by win having min(doc_id) < max(doc_id)),
marked as (
  select r, p, word, bool_or(coalesce(doc_id > d, false)) over (partition by r order by p rows between 49 preceding and current row) as gone
  from words left join firsts using (win)),
cut as (select r, count(*) as n, count_if(gone) as g, string_agg(word, ' ' order by p) filter (not gone) as kept from marked group by r)
select doc_id, cast(coalesce(n, 0) as bigint) as n_words, cast(coalesce(g, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from texts left join cut using (r)
""",
    "op7_suffix_dedup": r"""
with texts as (
  select row_number() over () as r, doc_id, regexp_extract_all(lower(hex(encode(coalesce(text, '')))), '.{1,200}') as hs from documents),
blocks as (select r, doc_id, k, hs[k] as own, hs[k] || coalesce(hs[k + 1], '') as h from texts, unnest(range(1, len(hs) + 1)) as t(k)),
bytes as (
  select r, doc_id, 100 * (k - 1) + i as p, substr(own, 2 * i + 1, 2) as b,
         case when 2 * i + 100 <= length(h) then substr(h, 2 * i + 1, 100) end as win
  from blocks, unnest(range(0, length(own) // 2)) as t(i)),
firsts as (select win, min(doc_id) as d from bytes where win is not null group by win having min(doc_id) < max(doc_id)),
marked as (
  select r, p, b, bool_or(coalesce(doc_id > d, false)) over (partition by r order by p rows between 49 preceding and current row) as gone
  from bytes left join firsts using (win)),
turned as (select *, gone and not coalesce(lag(gone) over (partition by r order by p), false) as opens from marked),
cut as (
  select r, count(*) as n, count_if(gone) as g, count_if(opens) as s, string_agg(b, '' order by p) filter (not gone) as kept
  from turned group by r)
select doc_id, cast(coalesce(n, 0) as bigint) as n_bytes, cast(coalesce(g, 0) as bigint) as n_removed,
  cast(coalesce(s, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from texts left join cut using (r)
""",
    "op8_embedding_dedup": """
with recursive ok as (
  select vec_id, label, embedding::double[] as v from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as x, b.vec_id as y from ok a join ok b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.93),
reach(x, y) as (select vec_id, vec_id from ok union select r.x, l.y from reach r join links l on r.y = l.x)
select e.vec_id, (select count(*) from links where x = e.vec_id) as n_links,
  coalesce((select min(y) from reach where x = e.vec_id), e.vec_id) as component_id,
  e.vec_id = coalesce((select min(y) from reach where x = e.vec_id), e.vec_id) as kept
from embeddings e
""",
}
