"""URL filters, mixing, decontamination and WARC: brute force, SQL and edge cases."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import queries as llm
from ledgerloom.llm.decontaminate import contaminated, decontaminate
from ledgerloom.llm.mixing import mix_sources
from ledgerloom.llm.url_filter import filter_urls, rules_table
from ledgerloom.llm.warc import audit, leaves, root_hash, shape, tree, warc_record
from tests.conftest import DATA


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("pages", "documents", "embeddings", "benchmark"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = llm.QUERIES[name](spark, DATA), duck.sql(llm.ORACLE_SQL[name])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_url_edge_cases(spark):
    rules = rules_table(spark, [("a.org", "/x", "block"), ("org", "/", "allow"), ("org", "/", "block"), (None, "/", "block"), ("b.org", "/é", "block")])
    urls = ["http://A.org/x1?q", "http://notb.a.org/", "HTTP://a.org", "a.org/x", None, "", "http://b.org/é", "http://a.org/y", "http://a.org/y", "x://", "http://a.org?/x"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id int, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(df, rules).collect()}
    assert got[0] == ("a.org", "/x1", "a.org/x", "block")
    assert got[1] == ("notb.a.org", "/", "org/", "block")  # block wins a tie
    assert got[2] == ("a.org", "", None, "allow") and got[10] == ("a.org", "", None, "allow")
    assert got[3] == got[4] == got[5] == got[9] == ("", "", None, "allow")
    assert got[6][2] == "b.org/é" and got[7] == got[8] == ("a.org", "/y", "org/", "block")
    assert filter_urls(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in filter_urls(df, rules.limit(0), default="block").collect()} == {"block"}


def targets(sizes, weights=(3, 1, 2), share=1.5):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 7, 40, 90, 300])), rng.choice(["b", "a", None, "c", "é", "b", "b"])) for i in range(600)]
    rows += [(600, None, "a"), (601, "x y", "a"), (601, "x y", "a"), (None, "z", "b"), (602, "q " * 5000, "tiny")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string").withColumn("copies", F.lit("old"))
    got = mix_sources(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = targets(sizes)
    taken = Counter()
    for r in got:
        assert r["copies"] in (0, 1, 2) and r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * want[r["source"]] + 1e-6
        taken[r["source"]] += r["copies"] * r["size"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(5, 0.01 * t), (s, taken[s], t)
    assert sorted(map(repr, got)) == sorted(map(repr, mix_sources(df.repartition(3)).collect()))
    assert mix_sources(df.limit(0)).count() == 0
    only_empty = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id int, text string, source string")
    assert {r["size"] for r in mix_sources(only_empty).collect()} == {0}


def brute_leaks(docs, items):
    grams = lambda t, k=5: [tuple(w[i : i + k]) for w in [(t or "").lower().split()] for i in range(len(w) - k + 1)]
    out = {}
    for d, text in docs:
        for i, item in items:
            k = min(5, len((item or "").split()))
            b, g = grams(item, k) if k else [], grams(text, k) if k else []
            m, size = len(b), min(len(b), len(g))
            best = None
            for s in range(len(g) - size + 1) if size else ():
                both = sum((Counter(b) & Counter(g[s : s + size])).values())
                j = both / (m + size - both)
                if j >= 0.8 and (best is None or j > best[0]):
                    best = (j, s, m + k - 1)
            if best:
                out[d, i] = best
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(n))) for i, n in enumerate([40, 40, 25, 60, 15])] + [(5, "one two"), (6, None), (7, ""), (8, "W1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    docs = []
    for d in range(60):
        body = text(rng.randrange(0, 120))
        if d % 2:
            leak = items[d % 5][1].split()
            for _ in range(d % 4):
                leak[rng.randrange(len(leak))] = "edited"
            body[len(body) // 2 : len(body) // 2] = leak if d % 3 else leak[:-2]
        docs.append((d, " ".join(body)))
    docs += [(60, None), (61, ""), (62, "x ONE\ttwo y"), (63, "w1 " * 500), (64, items[0][1] * 1), (64, items[0][1] * 1), (None, items[1][1])]
    df = spark.createDataFrame(docs, "doc_id int, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"], r["n_words"]) for r in contaminated(df, bench).collect()}
    want = brute_leaks(docs, items)
    assert got == want and len(want) > 8
    clean = decontaminate(df, bench)
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert contaminated(df.limit(0), bench).count() == 0 and contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_ways_agree(spark, monkeypatch):
    """Joined and looked-up shingles give the same on a whole corpus, repetitive texts included."""
    from ledgerloom.llm import decontaminate as module

    rng = random.Random(6)
    text = lambda n, of: " ".join(f"w{rng.randrange(of)}" for _ in range(n))
    items = [(1, text(30, 200)), (1, text(20, 200)), (None, text(25, 200)), (2, "r " * 40), (3, text(60, 3)), (2, "r " * 40)]
    docs = [(i, text(40, 200) + " " + items[i % 4][1][: -(i % 9)] + " " + text(i, 3)) for i in range(1, 40)] + [(50, "r " * 700), (51, text(300, 3)), (None, items[0][1]), (None, None)]
    df, bench = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    key = lambda rows: sorted(map(repr, rows))
    first = key(contaminated(df, bench).collect())
    for constants, rows in ((1, 1), (1, 10**6)):
        monkeypatch.setattr(module, "CONSTANTS", constants)
        monkeypatch.setattr(module, "BROADCAST_ROWS", rows)
        assert key(contaminated(df, bench).collect()) == first
    plain = brute_leaks([d for d in docs if d[0] is not None], [(i, t) for i, t in items if i in (3,)])
    assert {(d, i): v for (d, i), v in plain.items()} == {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in contaminated(df.where("doc_id is not null"), bench.where("item_id = 3")).collect()}
    assert len(first) > 25 and any("item_id=None" in r for r in first)


def test_hamming_blocks_find_all_within_the_radius_and_few_else(spark):
    from ledgerloom.llm import decontaminate as module

    rng = random.Random(7)
    pairs = []
    for _ in range(300):  # at the radius, spread over all blocks
        x = rng.getrandbits(64)
        pairs.append((x, x ^ sum(1 << b for b in rng.sample(range(64), module.RADIUS)), True))
    pairs += [(rng.getrandbits(64), rng.getrandbits(64), False) for _ in range(1500)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(i, signed(a), signed(b), near) for i, (a, b, near) in enumerate(pairs)], "i int, a bigint, b bigint, near boolean")
    left = df.select("i", "near", F.inline(module.fingerprint_blocks(F.col("a"), module.NEAR)))
    right = df.select("i", F.inline(module.fingerprint_blocks(F.col("b"))))
    met = {r["near"]: r["n"] for r in left.join(right, ["i", "block", "value"]).select("i", "near").distinct().groupBy("near").agg(F.count("*").alias("n")).collect()}
    assert met[True] == 300 and met[False] < 0.25 * 1500


def test_fingerprints_of_very_many_shingles(spark):
    from ledgerloom.llm import decontaminate as module

    df = spark.range(1).select(F.expr("transform(sequence(1, 72000), x -> xxhash64(x % 3 = 0, x % 2))").alias("h"))
    few = df.select(F.slice("h", 1, 60).alias("h"))  # the same shares of hashes
    assert df.select(module.simhash(F.col("h"))).first() == few.select(module.simhash(F.col("h"))).first()


def test_repetitive_text_makes_no_large_arrays(spark):
    df = spark.createDataFrame([(1, "a " * 200_000), (2, "b c " * 3000 + "a " * 2000)], "doc_id int, text string")
    bench = spark.createDataFrame([(1, "a " * 2000)], "item_id int, text string")
    got = {r["doc_id"]: (r["similarity"], r["start"], r["n_words"]) for r in contaminated(df, bench).collect()}
    assert got == {1: (1.0, 0, 2000), 2: (1.0, 6000, 2000)}


def test_decontamination_joins_when_the_benchmark_is_large(spark, monkeypatch):
    from ledgerloom.llm import decontaminate as module

    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id int, text string")
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j k l y"), (2, "z")], "doc_id int, text string")
    first = contaminated(docs, bench).collect()
    monkeypatch.setattr(module, "CONSTANTS", 1)
    monkeypatch.setattr(module, "BROADCAST_ROWS", 1)
    assert contaminated(docs, bench).collect() == first and first[0]["start"] == 1


def archive(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return leaves(df.select("page_id", warc_record(F.col("url"), F.col("html")).alias("record")), "page_id", "record")


def test_warc_audit(spark):
    rows = [(i, f"u{i}", f"body {i}") for i in range(0, 9000, 3)] + [(None, "n", "x"), (None, "n", "x"), (3, "u3", "again"), (6, None, None)]
    first = archive(spark, rows)
    assert audit(first, archive(spark, rows[::-1])).count() == 0
    hurt = [(i, u, (h or "") + "!" if i in (3000, 8997) else h) for i, u, h in rows]
    assert sorted(r["id"] for r in audit(first, archive(spark, hurt)).collect()) == [3000, 8997]
    lost = audit(first, archive(spark, rows[:2999] + rows[3000:])).collect()
    assert [(r["id"], r["right_hash"]) for r in lost] == [(8997, None)]
    none = first.limit(0)
    assert audit(none, none).count() == 0 and audit(first, none).count() == len(rows)
    form = shape(first)
    assert root_hash(tree(first, form)) == root_hash(tree(archive(spark, rows[::-1]), form))


def test_warc_files_read_back(spark, tmp_path):
    import datetime

    from ledgerloom.llm.warc import file_leaves, packed_record, parse_records, read_warc, record_uuid

    rows = [(i, f"http://h/{i}", f"<p>{'é' * i} body {i}\r\n\r\nWARC/1.0</p>") for i in range(70)] + [(70, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    when = F.lit(datetime.datetime(2024, 5, 6, 7, 8, 9))
    record = warc_record(F.col("url"), F.col("html"), record_uuid(F.col("page_id"), F.col("url")), when)
    raw = [r[0].encode() for r in df.select(record).orderBy("page_id").collect()]
    made = raw[5].split(b"\r\n")
    assert made[0] == b"WARC/1.0" and made[2].startswith(b"WARC-Record-ID: <urn:uuid:") and len(made[2]) == len("WARC-Record-ID: <urn:uuid:>") + 36
    assert made[3] == b"WARC-Date: 2024-05-06T07:08:09Z"

    def replica(name, change=None, pad=None, pack=False):
        folder = tmp_path / name
        folder.mkdir()
        for part in range(2):
            data = b""
            for i in range(part * 40, min(part * 40 + 40, len(raw))):
                one = raw[i].replace(b"body", b"b0dy") if i == change else raw[i]
                data += (b"\0" * 7 if i == pad else b"") + (packed_record(one) if pack else one)
            (folder / f"part{part}.warc{'.gz' if pack else ''}").write_bytes(data)
        return read_warc(spark, str(folder))

    whole = replica("a")
    got = {r["uri"]: (r["block"].decode(), r["intact"], r["type"], r["end"] - r["begin"]) for r in whole.collect()}
    assert got == {u or "": (h or "", True, "resource", len(raw[i])) for i, u, h in rows}
    packed = replica("p", pack=True).collect()
    assert {r["uri"]: r["block"].decode() for r in packed} == {u or "": h or "" for _, u, h in rows}
    assert [list(parse_records(b)) for b in (b"", b"junk", raw[3][:-20])] == [[]] * 3
    first = file_leaves(whole)
    assert audit(first, file_leaves(replica("b"))).count() == 0
    hurt = audit(first, file_leaves(replica("c", change=17))).collect()
    assert [r["place"] for r in hurt] == [17] and hurt[0]["left_hash"] != hurt[0]["right_hash"]
    padded = audit(first, file_leaves(replica("d", pad=50))).collect()  # moved, with the same bytes
    assert [(r["place"], r["left_hash"] == r["right_hash"]) for r in padded] == [(10, True)]
    assert [r["intact"] for r in replica("e", change=3).collect()].count(False) == 1


def test_audit_plan_does_not_grow_with_levels(spark):
    sizes = []
    for n in (40, 70_000):
        ids = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("record"))
        other = ids.withColumn("record", F.when(F.col("page_id") == n - 1, "x").otherwise(F.col("record")))
        found = audit(leaves(ids, "page_id", "record"), leaves(other, "page_id", "record"))
        sizes.append(found._jdf.queryExecution().optimizedPlan().toString().count("Relation"))
        assert [r["id"] for r in found.collect()] == [n - 1]
    assert sizes[0] == sizes[1] <= 3


def test_long_urls_and_hosts(spark):
    rules = rules_table(spark, [("a.b", "/x", "block"), ("", "/", "block"), ("c", "/", "block")])
    urls = ["http://" + "l." * 5000 + "a.b/x" + "y" * 100_000, "http://" + "a.b." * 3000 + "c", "http://b/x", "///", "http:///x"] + [None] * 3
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in filter_urls(df, rules).collect()}
    assert got == {0: ("a.b/x", "block"), 1: (None, "allow"), **dict.fromkeys(range(2, 8), (None, "allow"))}
    plan = filter_urls(df, rules)._jdf.queryExecution().toString()
    assert "Python" not in plan.split("== Physical Plan ==")[1].split("LocalTableScan")[0]


def test_identical_records_without_an_id_are_dealt_out(spark):
    same = spark.range(9000).select(F.lit(None).cast("bigint").alias("page_id"), F.lit("r").alias("record"), F.lit("x").alias("hash"), F.lit(1).alias("file"))
    found = leaves(same, "page_id", "record")
    sizes = sorted(r["count"] for r in found.groupBy("file").count().collect())
    assert sum(sizes) == 9000 and max(sizes) <= 4096
    assert found.groupBy("file").agg(F.max("end").alias("e"), F.count("*").alias("n")).where("e <> n").count() == 0


def test_mixing_rates_are_the_tilted_ones(spark):
    """Rates against the dual solved by bisection, document by document."""
    import math

    rng = random.Random(11)
    rows = [(i, "w " * rng.choice([1, 2, 5, 30, 200, 900]), rng.choice("abcc")) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = mix_sources(df).collect()
    want = targets(Counter({s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abc"}))
    for s in "abc":
        mine = [r for r in got if r["source"] == s]
        low, high = -50.0, 50.0  # of the multiplier a word
        for _ in range(200):
            lam = (low + high) / 2
            total = sum(r["size"] * min(2.0, math.exp(min(lam * r["size"], 700))) for r in mine)
            low, high = (lam, high) if total < want[s] else (low, lam)
        if want[s] >= 2 * sum(r["size"] for r in mine) - 1e-6:
            assert {r["rate"] for r in mine} == {2.0}
        else:
            assert all(abs(r["rate"] - min(2.0, math.exp(lam * r["size"]))) < 1e-6 for r in mine)
