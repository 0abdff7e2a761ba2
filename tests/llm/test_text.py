"""Language identification, extraction and the pipeline."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.html_extract import extract_text, main_text
from ledgerloom.llm.langid import Model, crc_remainder, fit, identify, posteriors, predict_texts
from tests.conftest import DATA


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    k, sizes = 3, [4, 1, 0, 3]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(size=(offsets[-1], k))
    model = Model(["a", "b", "c"], np.zeros((1, k)), np.exp(rng.normal(size=(k, k))), np.exp(rng.normal(size=k)))
    got = posteriors(model, scores, offsets)
    for low, high in zip(offsets[:-1], offsets[1:]):
        total = np.zeros((high - low, k))
        for path in itertools.product(range(k), repeat=high - low):
            w = np.prod([np.exp(scores[low + t, c]) for t, c in enumerate(path)]) * (model.starts[path[0]] if path else 0)
            w *= np.prod([model.moves[a, b] for a, b in zip(path, path[1:])])
            for t, c in enumerate(path):
                total[t, c] += w
        if high > low:
            assert np.allclose(got[low:high], total / total.sum(axis=1, keepdims=True))


def test_code_switching_and_odd_texts():
    rng = random.Random(2)
    make = lambda parts, n: " ".join(rng.choice(parts) + rng.choice(parts) for _ in range(n))
    a, b = ["tion", "the", "ing", "er"], ["que", "eau", "ière", "ment"]
    texts = [make(p, 80) for p in (a, b) for _ in range(40)]
    model = fit(texts, ["x"] * 40 + ["y"] * 40, rounds=3)
    names, share = predict_texts(model, pa.array([make(a, 30), make(b, 30) + " " + make(a, 90), None, "", "12 34 -", make(b, 1)]))
    assert names[:5] == ["x", "x", "und", "und", "und"] and names[5] == "y"
    assert 0.6 < share[1] < 0.9 and share[2:5].tolist() == [0, 0, 0]
    assert predict_texts(fit([], []), pa.array(["a"]))[0] == ["und"]
    assert predict_texts(fit(["a b"], ["x"]), pa.array(["c"]))[0] == ["x"]


def test_letters_are_those_of_unicode():
    model = fit(["ab cd ef", "gh ij kl"], ["x", "y"])
    signs = ["— – …", "“ ” «»", "€ 5 £", "😀 👍🏽", "。 、", "٠١٢", "\u00a0", "1 – 2", "\ud55c".encode("utf-8").decode() + "。"]
    names, share = predict_texts(model, pa.array(signs))
    assert names[:8] == ["und"] * 8 and share[:8].tolist() == [0] * 8 and names[8] != "und"
    letters = ["é", "ß", "漢", "ж", "한", "ا", "𐐀", "𠀀"]
    assert "und" not in predict_texts(model, pa.array(letters))[0]
    apart, plain = (predict_texts(model, pa.array([t]))[1] for t in ("ab — cd … ef", "ab cd ef"))
    assert apart == plain


def test_gradient_is_the_slope_of_the_likelihood():
    import itertools

    from ledgerloom.llm.langid import gradient

    rng = np.random.default_rng(4)
    k, width, n = 3, 12, 9
    model = Model(["a", "b", "c"], rng.normal(size=(width, k)), np.ones((k, k)), np.ones(k))
    log_moves, log_starts = rng.normal(size=(k, k)), rng.normal(size=k)
    label = rng.integers(k, size=n)
    fixed, grams, upto = rng.integers(width, size=(n, 6)), rng.integers(width, size=20), np.sort(np.concatenate([[0, 20], rng.choice(np.arange(1, 20), n - 1, replace=False)]))
    at = rng.integers(n, size=(2, 4))

    def likelihood(weights, moves, starts):
        score = np.array([weights[fixed[i]].sum(axis=0) + weights[grams[upto[i] : upto[i + 1]]].mean(axis=0) for i in range(n)])
        of = lambda row, path: starts[path[0]] + sum(score[i, c] for i, c in zip(row, path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
        return np.mean([of(row, label[row]) - np.log(sum(np.exp(of(row, p)) for p in itertools.product(range(k), repeat=4))) for row in at])

    import ledgerloom.llm.langid as module

    model.moves, model.starts = np.exp(log_moves), np.exp(log_starts)
    kept, module.WIDTH = module.WIDTH, width
    try:
        slopes = gradient(model, at, label, fixed, grams, upto)
    finally:
        module.WIDTH = kept
    values = [model.weights, log_moves, log_starts]
    for which, slope in enumerate(slopes):
        for place in np.ndindex(slope.shape):
            sides = []
            for step in (1e-5, -1e-5):
                moved = [v.copy() for v in values]
                moved[which][place] += step
                sides.append(likelihood(*moved))
            assert abs((sides[0] - sides[1]) / 2e-5 - slope[place]) < 1e-6


def test_long_texts_go_in_pieces(monkeypatch):
    import ledgerloom.llm.langid as module

    rng = random.Random(5)
    texts = [" ".join(rng.choice(["tion the ing", "que eau ière", "der und ßen", "12", "—"]) for _ in range(n)) for n in (3000, 1, 900)] + ["x" * 30_000, "é" * 9000 + " the", "", None]
    model = fit(["the ing tion er", "que eau ment", "der und ßen"] * 5, ["a", "b", "c"] * 5)
    whole = predict_texts(model, pa.array(texts))
    monkeypatch.setattr(module, "WORK", 1)
    parts = predict_texts(model, pa.array(texts))
    assert whole[0] == parts[0] and np.allclose(whole[1], parts[1]) and whole[0][-2:] == ["und", "und"]


def test_learning_takes_little_memory():
    import tracemalloc

    texts = [" ".join(f"{a}{i * 7919 % 9973}" for i in range(j, j + 9000)) for j, a in enumerate(["ab", "ç", "xyz"] * 14)]
    size = sum(len(t.encode()) for t in texts)
    assert size > 2 << 20
    tracemalloc.start()
    try:
        fit(texts, ["a", "b", "c"] * 14, rounds=0)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20 * size


def test_texts_read_in_blocks_have_the_same_features(monkeypatch):
    import ledgerloom.llm.langid as module

    texts = ["Ein Wort", "", "a", "   ", "1 2 3", "é ññ x9 " * 40, "one-very-long-word" * 30, "tail"]
    whole = module._read(texts)
    data = b"".join(t.encode() for t in texts)
    begin, end, offsets = module.words_of(module._lowered(np.frombuffer(data, np.uint8)), np.cumsum([0, *(len(t.encode()) for t in texts)]))
    plain = module.word_features(module._lowered(np.frombuffer(data, np.uint8)), begin, end)
    for block in (1, 7, 1 << 20):
        monkeypatch.setattr(module, "READ", block)
        got = module._read(texts)
        for a, b, c in zip(got, whole, (*plain, np.diff(offsets))):
            assert np.array_equal(a, b) and np.array_equal(a, c)
    assert [len(x) for x in module._read([])] == [0, 0, 1, 0]


def test_every_language_of_the_sample_is_learned(spark):
    rows = [(i, f"w{i % 150}x lang{i % 150} of{i % 150}", f"l{i % 150:03}") for i in range(600)] + [(7, "w7x", "l007"), (7, "w7x", "l007"), (None, "w3x", "l003")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = identify(df).collect()
    assert len(got) == len(rows) and len({r["lang_pred"] for r in got}) > 140
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {True}
    assert len({tuple(r) for r in got if r["doc_id"] == 7 and r["text"] == "w7x"}) == 1


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    wide = docs.withColumn("score", F.lit("clash"))
    rows = identify(wide).select("doc_id", "lang", "held_out", "lang_pred", "score").collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (crc_remainder(r["doc_id"]) == 1) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)
    assert identify(docs.limit(0)).count() == 0
    none = identify(docs.limit(3).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<nav>menu</nav><article><h1>T &amp; t</h1><p>One\n two<p>Three</article><footer>f</footer>", "T & t\nOne two\nThree"),
        ("<article><p>a<script>var x='</p>'</script>b</p><!-- <p>no</p> --><p>c</article>", "a b\nc"),
        ("<article><p>x</p><div class='comments'><p>" + "we said it of the and to " * 9 + "</p></div></article>", "x"),
        ("<article><p>x</p><form><label>Name</label></form><aside>s</aside><div class=ad>buy</div>", "x"),
        ("<article>a<br>b<br><br>c</article>", "a b\nc"),
        ("<article>&#233;&eacute;&nosuch; &lt;b&gt;</article>", "éé&nosuch; <b>"),
        ("<article><p style='display: none'>no</p><p hidden>no</p><p>yes</article>", "yes"),
        ("<body><div><p>" + "the cat is on the mat and it was good " * 4 + "</p><p>Short.</p></div><div><a href=x>link one</a></div>", ("the cat is on the mat and it was good " * 4).strip() + "\nShort."),
        (None, ""), ("", ""), ("<html><body></body></html>", ""), ("<article", ""),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


def by_hand(found):
    """Another writing of the two passes, for pages without containers: (text, characters in links)."""
    stop = set("the of and a to in is that it was for on".split())
    labels = []
    for text, linked in found:
        words = [w for w in text.split() if w.isalpha()]
        share = sum(w in stop for w in words) / max(1, len(words))
        if linked > len(text) / 2:
            labels.append("bad")
        elif len(text) < 70:
            labels.append("open")
        elif share >= 0.30 or (share >= 0.15 and len(text) >= 200) or (share < 0.15 and len(text) >= 200 and not linked):
            labels.append("good")
        elif share >= 0.15:
            labels.append("open")
        else:
            labels.append("bad")
    out = []
    for i, label in enumerate(labels):
        if label == "open":
            ranked = sorted((abs(i - j), x != "good") for j, x in enumerate(labels) if x != "open")
            label = "bad" if not ranked or ranked[0][1] else "good"
        if label == "good":
            out.append(found[i][0])
    return "\n".join(out)


def test_two_passes_equal_a_plain_writing_of_them():
    rng = random.Random(21)
    stop, plain = "the of and a to in is that".split(), [f"{c}{v}zq" for c in "bdfgklmnprst" for v in "aeiou"]
    several = set()
    for _ in range(400):
        found, page = [], ""
        for _ in range(rng.randrange(1, 9)):
            share = rng.choice([0, 0.1, 0.2, 0.25, 0.4, 0.6])
            words = [rng.choice(stop if rng.random() < share else plain) for _ in range(rng.choice([1, 3, 8, 14, 20, 45, 80]))]
            linked = rng.choice([0, 0, 0, len(words) // 4, len(words)])
            text, link = " ".join(words), " ".join(words[:linked])
            found.append((text, len(link)))
            tag = rng.choice(["p", "div", "li", "td", "h2"])
            page += f"<{tag}>" + (f"<a href='x'>{link}</a> " if linked else "") + " ".join(words[linked:]) + f"</{tag}>"
        got = main_text(f"<html><body>{page}</body></html>")
        assert got == by_hand(found)
        several.add((got == "", got.count("\n")))
    assert len(several) > 5


def test_names_are_read_whole():
    long = ("the cat is on the mat and it was good " * 6).strip()
    for open_tag in ('<div class="content no-sidebar">', '<article class="post has-comments">', '<article><p data-hidden="0">', '<article><div title="hidden gems">',
                     '<article><div data-note="class=ad">', "<body class='login has-sidebar'><div>", '<div class="post with-ads">', "<div class='story' style='color: red'>"):
        assert main_text(f"{open_tag}{long}") == long
    for open_tag in ("<div class='comment-list'>", "<div id=site-footer>", "<div class='x cookie-notice'>", "<div role=navigation>", "<div hidden>", "<div class='ad-slot-3'>", "<article class='comment'>"):
        assert main_text(f"{open_tag}{long}</div></article><p>{long} again") == f"{long} again"
    assert main_text(f'<div class="content"><h2>Top</h2></div><div class="text">{long}</div>') == f"Top\n{long}"
    for open_tag in ("<div class='entry-content'>", "<div class=post-body>"):
        page = f"{open_tag}<h1>T</h1><p>{long}</p></div><div class='post-comments'><p>{long}</p></div><p>{long[:79]}</p>"
        assert main_text(page) == f"T\n{long}\n{long[:79]}"
    assert main_text(f"<p>{long}</p><p>Copyright 2020 by us</p>") == long
    tables = "<table><tr><td>" * 30 + long + "</td></tr></table>" * 30
    assert main_text(f"<article>{tables}<p>end</article>") == f"{long}\nend"
    assert main_text(f"<article><p>{'word ' * 300_000}</p></article>") == ("word " * 300_000).strip()


def test_extraction_keeps_rows(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").withColumn("text", F.lit("clash"))
    rows = extract_text(pages).collect()
    assert len(rows) == pages.count() and all(r["n_chars"] == len(r["text"]) > 0 for r in rows)
    assert extract_text(pages.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "span_dedup", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "1 2 3", "en", "src1", 5), (None, "the and of", "en", None, 10)], docs.schema)
    now, last = docs.unionAll(odd), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        last, now = now, corpus_pipeline.materialize(stage(spark, now, DATA), name)
        assert now.dtypes == docs.dtypes and now.count() <= last.count()
    ids = {r[0] for r in now.select("doc_id").collect()}
    assert 9001 not in ids and 9002 not in ids and None in ids
    end = corpus_pipeline.mixing(spark, now, DATA)
    assert end.columns[: len(docs.columns)] == docs.columns and end.count() <= now.count()
    assert {r[0] for r in end.select("copies").distinct().collect()} <= {1, 2}


def test_pipeline_keeps_rows_without_an_id_of_their_own(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    apart = [" ".join(f"w{i}x{k}" for k in range(30 + i)) for i in range(8)]
    rows = [(None, apart[0], "en", "s", 1), (None, apart[1], "en", "s", 1), (None, apart[1], "en", "s", 1)]
    rows += [(5, apart[i], "en", "s", 1) for i in (2, 3, 3)] + [(i, apart[i], "en", "t", 1) for i in (6, 7)]
    df = spark.createDataFrame(rows, docs.schema)
    once = corpus_pipeline.materialize(corpus_pipeline.near_dedup(spark, df, DATA), "test")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in once.collect())
    assert got == sorted([(0, apart[0]), (0, apart[1]), (0, apart[1]), (5, apart[2]), (5, apart[3]), (6, apart[6]), (7, apart[7])])
    mixed = corpus_pipeline.mixing(spark, df, DATA).collect()
    assert {r["source"]: r["source_size"] for r in mixed} == {s: sum(len(x[1].split()) for x in rows if x[3] == s) for s in "st"}
    taken = lambda s: sum(r["copies"] * r["size"] for r in mixed if r["source"] == s)
    assert all(abs(taken(r["source"]) - r["target"]) <= 40 for r in mixed) and len(mixed) <= len(rows)
    assert None in {r["doc_id"] for r in mixed}


def test_pipeline_with_clashing_columns_and_none_at_all(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = ("score", "held_out", "lang_pred", "_id", "_sum", "id", "sum", "new", "size", "target", "copies", "n_removed", "row", "root", "component_id", "_leaks", "item_id", "grams")
    wide = docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in extra})
    none, now, plain = wide.limit(0), wide, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now, plain, none = (corpus_pipeline.materialize(stage(spark, x, DATA), name) for x in (now, plain, none))
        assert now.columns == wide.columns and none.count() == 0 and none.dtypes == wide.dtypes
    rows = now.collect()
    assert all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in extra)
    assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((r["doc_id"], r["text"]) for r in plain.collect())
    mixed = corpus_pipeline.mixing(spark, now, DATA)
    assert corpus_pipeline.mixing(spark, none, DATA).count() == 0 and len(mixed.columns) == len(set(mixed.columns))
    took = mixed.collect()
    assert all(r["copies"] in (1, 2) and r["size"] == len(re.findall(r"[^\x20\x09-\x0d]+", r["text"])) and r["score"] == f"score:{r['doc_id']}" for r in took)


def test_cut_texts_keep_their_characters(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    shared = "".join(chr(0x4E00 + i * 7 % 900) for i in range(40))  # three bytes each
    rows = [(1, "\ufffd one " + shared, "en", "s", 1), (2, shared[3:30] + " two \ufffd\ufffd and é", "en", "s", 1), (3, shared, "en", "s", 1), (4, None, "en", "s", None)]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.span_dedup(spark, spark.createDataFrame(rows, docs.schema), DATA).collect()}
    assert got == {1: (rows[0][1], 46), 2: (" two \ufffd\ufffd and é", 13), 4: (None, None)}


def test_span_dedup_joins_the_texts_once(spark):
    import corpus_pipeline

    rows = corpus_pipeline.span_dedup(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("MapInArrow") == 1
