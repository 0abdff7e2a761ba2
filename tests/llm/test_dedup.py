"""Near-duplicates, spans and embeddings against brute force, with edge cases."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import spans, tokens
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.embed_dedup import near_duplicate_vectors
from ledgerloom.llm.simhash import near_duplicates, simhash_components
from ledgerloom.llm.substring import remove_repeated_words
from ledgerloom.llm.suffix import remove_repeats


class Sets(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def corpus(seed=1, n=120):
    """Texts with copies, near copies, shared passages and odd ones."""
    rng = random.Random(seed)
    word = lambda: rng.choice("the of and to é ß 漢字 alpha beta gamma delta".split()) + str(rng.randrange(40))
    passage = " ".join(word() for _ in range(70))
    out = []
    for i in range(n):
        kind = rng.randrange(6)
        if kind == 0 and out:
            out.append(rng.choice(out))
        elif kind == 1 and out:
            words = (rng.choice(out) or "x").split()
            if words:
                words[rng.randrange(len(words))] = "changed"
            out.append(" ".join(words))
        elif kind == 2:
            out.append(" ".join(word() for _ in range(rng.randrange(30))) + "\n" + passage + "\t" + " ".join(word() for _ in range(rng.randrange(30))))
        else:
            out.append(" ".join(word() for _ in range(rng.randrange(150))))
    out += [None, "", " \n", "a", "ab " * 400, "ab " * 300, "z" * 200, "z" * 120, "x" * 49, "x" * 50, "x" * 50, "y " * 60 + passage[:55]]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"sum": F.lit("clash"), "fp": F.lit(1)}).repartition(5)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 100)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = dict(connected_components(df, "a", "b").collect())
    assert {n: got.get(n, n) for n in range(61)} == dict.fromkeys(range(61), 0)
    assert got[101] == got[200] == 100 and set(got.values()) == {0, 100}
    assert connected_components(df.limit(0), "a", "b").count() == 0


def fingerprint(text):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(low))
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(p, seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, docs):
    rows, df = docs
    prints = {i: fingerprint(t) for i, t in rows}
    sets = Sets()
    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                sets.join(i, j)
    got = {r[0]: (r[1], r[2]) for r in simhash_components(df).collect()}
    assert got == {i: (f"{p:016x}", sets.find(i)) for i, p in prints.items()}
    assert simhash_components(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d"), (None, None), (5, "a b c d"), (5, "a b c d")], "doc_id bigint, text string")
    assert sorted((r[0] or -1, r[2]) for r in simhash_components(odd).where("component_id is not null").collect()) == [(-1, 5), (5, 5), (5, 5)]


def test_near_duplicates_link_similar_texts(spark, docs):
    rows, df = docs
    shingles = {}
    for i, t in rows:
        w = (t or "").lower().split()
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    got = dict(near_duplicates(df).collect())
    sets = Sets()
    missed = 0
    for i in shingles:
        for j in shingles:
            both = len(shingles[i] & shingles[j])
            if i < j and both >= 0.8 * len(shingles[i] | shingles[j]):
                sets.join(i, j)
                missed += got[i] != got[j] and both >= 0.95 * len(shingles[i] | shingles[j])
    assert missed == 0
    assert all(sets.find(i) == sets.find(got[i]) for i in shingles)  # nothing else is linked


def test_near_duplicates_meet_behind_unlike_texts(spark, monkeypatch):
    import ledgerloom.llm.simhash as module

    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    # Boilerplate makes all texts meet, at 0.7; each has one twin, at 0.85.
    base, rows = words(300), []
    for i in range(0, 240, 2):
        own = base + words(28)
        rows += [(i, " ".join(own + words(29))), (i + 1, " ".join(own + words(29)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    hashes = [module.shingle_hashes(t, 5) for _, t in rows]
    keys = np.array([[module.majority(module._remixed(h, salt)) >> s & 0xFFFFFFFF for salt in range(4) for s in (0, 32)] for h in hashes])
    meet = [i for i in range(0, 240, 2) if any(int(a ^ b).bit_count() <= 2 for a, b in zip(keys[i], keys[i + 1]))]
    assert len(meet) > 80
    for small in (16, 2):
        monkeypatch.setattr(module, "SMALL", small)
        got = dict(near_duplicates(df, tables=8, bits=32).collect())
        assert [i for i in meet if got[i + 1] != i] == []
        assert all(got[i] in (i, i & ~1) for i in got)


def test_near_duplicates_join_few_unlike_pairs(spark, monkeypatch):
    import ledgerloom.llm.simhash as module

    rng = random.Random(18)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    base = words(300)  # similarities of 0.53: a third of all pairs meet
    rows = [(i, " ".join(base + words(128))) for i in range(240)]
    rows += [(240, rows[7][1] + " and more"), (241, rows[9][1] + " and less")]
    joined, real = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, label="step": (out := real(df, label), label == "links" and joined.append(out.count()))[0])
    got = dict(near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect())
    assert {i: c for i, c in got.items() if c != i} == {240: 7, 241: 9}
    assert sum(joined) < 1000
    # Pairs at the similarity keep five standard deviations.
    assert module.most_apart(768, 0.8) == 166 and module.most_apart(100, 0.8) == 33


def test_near_duplicates_join_few_unlike_pairs_of_few_shingles(spark, monkeypatch):
    import ledgerloom.llm.simhash as module

    rng = random.Random(28)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    base = words(30)  # 26 of 44 shingles, a similarity of 0.42
    rows = [(i, " ".join(base + words(18))) for i in range(240)]
    rows += [(240, rows[7][1] + " and more"), (241, rows[9][1] + " and less")]
    joined, real = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, label="step": (out := real(df, label), label == "links" and joined.append(out.count()))[0])
    got = dict(near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect())
    assert {i: c for i, c in got.items() if c != i} == {240: 7, 241: 9}
    assert sum(joined) < 100


def test_how_often_a_bit_differs_between_sets_of_few_shingles():
    import itertools

    import ledgerloom.llm.simhash as module

    for a, b, both in ((4, 5, 4), (5, 5, 3), (3, 6, 2), (2, 3, 0)):
        apart = 0
        for bits in itertools.product((0, 1), repeat=a + b - both):
            x, y = bits[:a], bits[a - both :]
            apart += (2 * sum(x) > a) != (2 * sum(y) > b)
        assert module.differing(a, b, both) == pytest.approx(apart / 2 ** (a + b - both))
    allowed = module.limits(768, 0.8)
    assert len(allowed) == module.FEW + 1 and min(allowed[1:]) == allowed[-1] == module.most_apart(768, 0.8)
    rng = np.random.default_rng(4)
    for a, b, both in ((4, 5, 4), (13, 13, 12), (22, 23, 20), (50, 60, 49)):  # the least overlaps at 0.8
        assert 0.8 <= both / (a + b - both) < 0.86
        for _ in range(100):
            x = rng.integers(0, 1 << 63, a + b - both).astype(np.uint64)
            found = int(np.bitwise_count(module.majorities(x[:a], 12) ^ module.majorities(x[a - both :], 12)).sum())
            assert found <= allowed[min(a, b)]


def test_texts_meet_in_buckets_of_many():
    import pyarrow as pa

    import ledgerloom.llm.simhash as module

    n = 80_000  # more than 16 bits count
    words = np.random.default_rng(3).integers(0, 1 << 63, (n, 2)).astype(np.uint64)
    twins = np.arange(100, 40_000, 997)
    words[n - 1 - twins] = words[twins] ^ np.uint64(1 << 5 | 1 << 40)
    node = np.arange(n, dtype=np.int64)
    batches = [
        pa.RecordBatch.from_arrays([pa.array(node[a : a + 10_000]), pa.array(np.full(10_000, 300, np.int32)), pa.array(node[a : a + 10_000]),
                                    pa.array(words[a : a + 10_000].view(np.int64).tolist())], ["node", "size", "root", "fps"])
        for a in range(0, n, 10_000)
    ]
    spread = [b for b in module._spread(4, 28, 1, 2)(iter(batches))]
    rows = sorted((r for b in spread for r in b.to_pylist()), key=lambda r: r["bucket"])
    sent = pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("payload", pa.binary())]))
    for again in (False, True):
        found = {(r["a"], r["b"]) for b in module._meet(0.8, 28, again)(iter([sent])) for r in b.to_pylist()}
        pairs = {p for p in found if p[1] >= 0}
        want = {(int(i), int(n - 1 - i)) for i in twins}
        assert (pairs >= want and len(pairs) < len(want) + 50) if not again else pairs <= want


def test_near_duplicates_compare_sets_of_shingles(spark):
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    line = "the same line again and over "
    rows = [(i, line * 2000 + words(200)) for i in range(4)]  # unlike but for the line
    own = words(300)
    rows += [(10, own), (11, line * 100 + own), (12, own + " " + line * 300)]  # alike but for it
    got = dict(near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 10: 10, 11: 10, 12: 10}


def test_near_duplicates_find_pairs_at_the_threshold(spark):
    rng = random.Random(10)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i in range(0, 600, 2):  # 160 of 200 shingles, or 40 of 50, are common
        n = 160 if i % 4 else 40
        own = words(n + 4)
        rows += [(i, " ".join(own + words(n // 8))), (i + 1, " ".join(own + words(n // 8)))]
    got = dict(near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert sum(got[i + 1] == i for i in range(0, 600, 2)) >= 0.97 * 300
    assert all(got[i] in (i, i & ~1) for i in got)


def test_remove_repeated_bytes(spark, docs):
    rows, df = docs
    seen, want = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        keep = np.ones(len(b), bool)
        windows = [b[p : p + 50] for p in range(len(b) - 49)]
        for p, w in enumerate(windows):
            if w in seen:
                keep[p : p + 50] = False
        seen.update(windows)
        kept = np.frombuffer(b, np.uint8)[keep].tobytes()
        runs = int((np.diff(np.concatenate([[1], keep, [1]]).astype(int)) == -1).sum())
        want[i] = (len(b), int((~keep).sum()), runs, kept)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(df).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 3000
    assert remove_repeats(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "q" * 60), (1, "q" * 60), (1, "q" * 60), (1, "p" * 60), (2, "q" * 55)], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in remove_repeats(odd).collect()) == [(0, 0), (1, 0), (1, 0), (1, 0), (2, 55)]


def test_shuffle_files_go_with_the_step_that_made_them(spark, docs):
    from ledgerloom.plans import materialize

    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    spark._jvm.System.gc()
    time.sleep(2)
    before = files()
    table = materialize(spark.range(1000).repartition(7, "id"))
    end = time.time() + 20
    while files() > before and time.time() < end:
        time.sleep(0.2)
    assert files() <= before and table.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    # Only the last step of the removal is left to run with the result.
    plan = remove_repeats(docs[1])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Join") == 1


def test_runs_of_a_bucket_are_written_in_order():
    import ledgerloom.llm.suffix as module

    rows = module._rows(np.array([2, 1, 2, 1]), np.array([7, 7, 5, 7]), np.array([3, 9, 8, 4])).to_pydict()
    assert list(zip(*rows.values())) == [(1, 7, 4), (1, 7, 9), (2, 5, 8), (2, 7, 3)]


def test_remove_repeats_keeps_other_columns(spark):
    rows = [(1, "q" * 60 + "é", "x", [1]), (2, "é" + "q" * 55, None, None), (2, None, "n", []), (None, "q" * 60, "u", [2, 3])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, tags array<int>")
    got = remove_repeats(df, as_text=True, keep=("lang", "tags"))
    assert got.columns[-3:] == ["kept", "lang", "tags"] and dict(got.dtypes)["tags"] == "array<int>"
    found = [(r["doc_id"], r["kept"], r["lang"], r["tags"], r["n_removed"]) for r in got.collect()]
    want = [(1, "q" * 60 + "é", "x", [1], 0), (2, "é", None, None, 55), (2, "", "n", [], 0), (None, "q" * 60, "u", [2, 3], 0)]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_remove_repeated_bytes_of_a_crowd_in_one_document(spark):
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    anchor = "fdgwqssozcqgabze"  # of a low identifier
    runs = [letters(60) + anchor + letters(60) for _ in range(300)]
    for k, n in ((5, 60), (9, 61)):  # one letter more is alike by chance
        rows = [(1, "".join(runs)), (2, letters(30) + runs[k][40:100] + letters(30))]
        got = remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect()
        assert {r["doc_id"]: r["n_removed"] for r in got} == {1: 0, 2: n}


def test_remove_repeated_words(spark, docs):
    rows, df = docs
    seen, want = set(), {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        keep = [True] * len(words)
        windows = [tuple(words[p : p + 50]) for p in range(len(words) - 49)]
        for p, w in enumerate(windows):
            if w in seen:
                keep[p : p + 50] = [False] * 50
        seen.update(windows)
        left = " ".join(w for w, k in zip(words, keep) if k)
        want[i] = (len(words), keep.count(False), hashlib.sha256(left.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeated_words(df).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 500
    assert remove_repeated_words(df.limit(0)).count() == 0


def removed(rows, length, step=None):
    """Brute force: bytes (or words, with ``step``) that each text loses."""
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        tokens_ = (t or "").encode() if step is None else tuple(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
        gone = np.zeros(len(tokens_), bool)
        for p in range(len(tokens_) - length + 1):
            if seen.setdefault(tokens_[p : p + length], i) < i:
                gone[p : p + length] = True
        out[i] = int(gone.sum())
    return out


def test_pointers_double_over_several_rounds(spark, docs, monkeypatch):
    import ledgerloom.llm.suffix as module

    rows, df = docs
    assert module.depths(50) == [25, 50] and module.depths(70) == [18, 35, 70]
    assert module._offsets([18, 35, 70]) == [0, 17, 35, 52]
    for length, crowd in ((70, 64), (50, 1), (40, 0)):
        monkeypatch.setattr(module, "CROWD", crowd)  # at 0 every window goes by pointers
        got = {r["doc_id"]: r["n_removed"] for r in remove_repeats(df, length=length).collect()}
        assert got == removed(rows, length)


def test_compaction_decides_what_goes(spark, docs, monkeypatch):
    import ledgerloom.llm.substring as module

    rows, df = docs
    want = removed(rows, 50, "words")
    whole = {r["doc_id"]: r["n_removed"] for r in remove_repeated_words(df).collect()}
    assert whole == want
    real = module.compacted
    monkeypatch.setattr(module, "compacted", lambda repeated: real(repeated).limit(0))
    none = {r["doc_id"]: r["n_removed"] for r in remove_repeated_words(df).collect()}
    assert none != want and sum(none.values()) < sum(want.values()) / 2


def test_paths_join_edges_and_name_their_source(spark):
    import ledgerloom.llm.substring as module

    rng = random.Random(14)
    words = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    long = words(900)
    rows = [(1, " ".join(words(30) + long)), (2, " ".join(words(70) + long[:400])), (3, " ".join(long[200:] + words(9)))]
    base = module.with_key(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text")
    found = module.repeated_spans(base, 50)
    spans_ = [r for r in found.collect() if r["count"] > 1]
    # Ten and more edges became one span each, in step with the first document.
    assert sorted((r["doc_id"], r["source_id"]) for r in spans_ if r["count"] > 150) == [(2, 1), (3, 1)]
    assert all(r["source_start"] - r["start"] == {2: 30 - 70, 3: 230}[r["doc_id"]] for r in spans_)
    assert {r["doc_id"]: r["n_removed"] for r in remove_repeated_words(base.select("doc_id", "text")).collect()} == {1: 0, 2: 400, 3: 700}
    # A span whose words differ from its source's is not cut.
    wrong = found.withColumn("source_start", F.col("source_start") + 1)
    assert module.confirmed(base, wrong, 50).count() == 0 and module.confirmed(base, found, 50).count() == found.count()


def test_repeated_ids_with_other_texts(spark):
    rng = random.Random(15)
    words = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    a, b, c = words(60), words(60), words(60)
    rows = [(None, a), (1, a), (1, a), (1, b), (2, a + " " + c), (2, c), (3, b), (4, None), (4, ""), (5, c)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"sum": F.lit(1), "runs": F.lit("x"), "path": F.lit("p")})
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in remove_repeated_words(df).collect())
    assert got == sorted([(0, 60, 0), (1, 60, 0), (1, 60, 0), (1, 60, 0), (2, 120, 60), (2, 60, 0), (3, 60, 60), (4, 0, 0), (4, 0, 0), (5, 60, 60)])


def test_segments_cover_every_window_once():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 5000, dtype=np.uint8)
    data[1000:1400] = 97  # ties
    offsets = np.array([0, 30, 30, 900, 3000, 5000])
    s = spans.segments(spans.byte_grams(data, 16), offsets, 16, 50)
    assert s.count.max() <= 35
    for d in range(5):
        covered = np.concatenate([np.arange(a, a + c) for a, c in zip(s.start[s.doc == d], s.count[s.doc == d])] or [np.empty(0, int)])
        assert covered.tolist() == list(range(max(0, offsets[d + 1] - offsets[d] - 49)))


def test_long_texts_come_in_pieces(monkeypatch):
    import pyarrow as pa

    text = "".join(random.Random(4).choice("ab \n") for _ in range(30_000))
    whole = tokens.word_hashes(pa.array([text, None, "x y", text]))
    monkeypatch.setattr(tokens, "PIECE", 512)
    parts = tokens.word_hashes(pa.array([text, None, "x y", text]))
    assert (whole[0] == parts[0]).all() and whole[1].tolist() == parts[1].tolist()
    n = len(text.split())
    assert whole[1].tolist() == [0, n, n, n + 2, 2 * n + 2]
    windows = lambda most: {(int(i), int(p)) for d, a, b in tokens.pieces(np.array([0, 10, 2000]), 50, most) for i, x, y in zip(d, a, b) for p in range(x, y - 49)}
    assert windows(100) == windows(10**6) == {(1, p) for p in range(10, 1951)}


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 8))
    vectors = [(base[i % 12] + rng.normal(size=8) * 0.13).tolist() for i in range(300)]
    rows = [(i, v, i % 3) for i, v in enumerate(vectors)] + [(300 + i, vectors[0], 0) for i in range(5)]
    rows += [(400, None, 0), (401, [0.0] * 8, 0), (402, [math.nan] + [1.0] * 7, 0), (403, [None] + [1.0] * 7, 0), (404, vectors[0], None), (405, [math.inf] * 8, 0), (406, [], 0), (407, vectors[0][:4], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("node", F.lit("clash"))
    import ledgerloom.llm.embed_dedup as module

    stored = {r["vec_id"]: r["embedding"] for r in df.select("vec_id", "embedding").collect()}
    good = [(i, np.array(stored[i], dtype=float), lab) for i, v, lab in rows if v and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, sets = dict.fromkeys(stored, 0), Sets()
    for i, x, a in good:
        for j, y, b in good:
            if i != j and a == b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[i] += 1
                sets.join(i, j)
    want = {i: (links[i], sets.find(i), sets.find(i) == i) for i in stored}
    assert {r[0]: tuple(r)[1:] for r in near_duplicate_vectors(df).collect()} == want
    kept = module.PER_PIVOT, module.BLOCK
    try:  # many pivots and blocks give the same
        module.PER_PIVOT, module.BLOCK = 20, 16
        assert {r[0]: tuple(r)[1:] for r in near_duplicate_vectors(df).collect()} == want
    finally:
        module.PER_PIVOT, module.BLOCK = kept
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def test_embeddings_with_repeated_ids(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [2.0, 0.0], 0), (1, [0.0, 1.0], 1), (2, [1.0, 0.1], 0), (3, [0.0, 3.0], 1), (3, [0.0, 3.0], 1), (None, [1.0, 0.0], 0), (9, None, 0), (9, [1.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = sorted((-1 if r[0] is None else r[0], r[1], r[2] or 0, r[2], r[3]) for r in near_duplicate_vectors(df).collect())
    by = {}
    for v, n, _, c, k in got:
        by.setdefault(v, []).append((n, c, k))
    assert by == {-1: [(0, None, True)], 0: [(2, 0, True)], 1: [(2, 0, False), (2, 1, True)], 2: [(2, 0, False)], 3: [(2, 1, False), (2, 1, False)], 9: [(0, 9, True), (0, 9, True)]}
