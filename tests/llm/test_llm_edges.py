"""Odd rows for every operator and the whole pipeline; the language model's training step against loops."""

import math

import numpy as np
import pytest

import corpus_pipeline
from seqlake.llm import chat, langid, packing, quality, token_counts
from seqlake.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
LONG = "plain words in a very long text " * 40_000
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "same text here"), (5, "same text here"), (5, "another text"), (None, "no id at all"), (None, None), (6, "汉字"), (7, "1234 !?")]
#: Columns named like results.
CLASH = "score double, held_out boolean, predicted int, lang_pred string, n_words long, n_tokens long, piece int, sequence_id long, length long, offset long, row_key long"


def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0.5, True, 9, "x", 9, 9, 9, 9, 9, 9, 9) for i, t in TEXTS], "doc_id long, text string, lang string, source string, " + CLASH)


def keys(rows):
    return sorted(str(r["doc_id"]) for r in rows)


def test_odd_rows_of_single_text_operators(spark):
    df, want = odd(spark), sorted(str(i) for i, _ in TEXTS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 8)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    scored = quality.score_quality(df, model).collect()
    assert keys(scored) == want and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in scored)
    assert {r["held_out"] for r in scored if r["doc_id"] is None} == {None}
    assert len({r["score"] for r in scored if r["doc_id"] in (1, 2)}) == 1
    kept = quality.keep_good(df, model, 0.0)
    assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    assert quality.score_quality(df.limit(0), model).count() == 0 and quality.keep_good(df.limit(0), model).count() == 0
    assert quality.fit(df.limit(0), labels.limit(0)).score(np.zeros((1, quality.N_MEASURES)))[0] == 0.5

    counts = token_counts.token_counts(df, PATH).collect()
    assert keys(counts) == want and {(r["n_words"], r["n_tokens"]) for r in counts if r["doc_id"] in (1, 2, 3)} == {(0, 0)}
    assert next(r["n_words"] for r in counts if r["doc_id"] == 4) == 7 * 40_000
    assert token_counts.token_counts(df.limit(0), PATH).count() == 0

    found = langid.identify(df, langid.fit(df)).collect()
    assert keys(found) == want and {r["lang_pred"] for r in found if r["doc_id"] in (1, 2, 3, 7)} == {"und"}
    assert langid.identify(df.limit(0), langid.fit(df.limit(0))).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df, langid.fit(df.limit(0))).collect()} == {"und"}


def test_odd_rows_of_packing(spark):
    df = odd(spark)
    rows = packing.pack_documents(df, PATH, 64).collect()
    assert keys([r for r in rows if r["piece"] == 0]) == sorted(str(i) for i, _ in TEXTS)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in by.values():
        assert [o for o, _ in sorted(x)] == np.cumsum([0, *[n for _, n in sorted(x)]]).tolist()[:-1] and sum(n for _, n in x) <= 64
    # Equal lengths: as many sequences as can be, whichever piece lies where.
    same = spark.createDataFrame([(i, "a b c") for i in range(50)], "doc_id long, text string")
    packed = packing.pack_documents(same, PATH, 10).collect()
    n = packed[0]["length"]
    assert {r["length"] for r in packed} == {n} and len({r["sequence_id"] for r in packed}) == math.ceil(50 / (10 // n))
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


def test_odd_rows_of_chat(spark):
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", None), (2, 0, None, ""), (None, 0, "user", "a"), (None, 0, "assistant", "b"), (3, 5, "assistant", "x"), (3, 5, "assistant", "x"), (4, None, "user", "first")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn int, role string, text string, example int, prompt int")
    got = {r["conv_id"]: r for r in chat.digest(chat.examples(df)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 2, 2: 1, None: 2, 3: 2, 4: 1}
    assert {k: r["loss_chars"] for k, r in got.items()} == {1: 0, 2: 0, None: 1, 3: 2, 4: 0}
    assert chat.examples(df.limit(0)).count() == 0


def loop_training(rows, epochs, rate):
    """The same model by sums over every bucket and language."""
    languages = sorted({r[0] for r in rows})
    rng = np.random.default_rng(11)
    d, k = langid.DIMENSIONS, len(languages)
    e = rng.normal(0, 1 / d, (langid.BUCKETS, d)).tolist()
    w, b = [[0.0] * k for _ in range(d)], [0.0] * k
    order = rng.permutation(len(rows))
    fit = order[: len(rows) - int(0.15 * len(rows))]
    step, total = 0, epochs * len(fit)
    for _ in range(epochs):
        for i in rng.permutation(fit):
            now = rate * (1 - step / total)
            step += 1
            lang, bucket, count = rows[i]
            share = [float(c) / float(count.sum()) for c in count]
            x = [sum(s * e[q][j] for s, q in zip(share, bucket)) for j in range(d)]
            z = [sum(x[j] * w[j][c] for j in range(d)) + b[c] for c in range(k)]
            p = [math.exp(v - max(z)) for v in z]
            p = [v / sum(p) - (languages[c] == lang) for c, v in enumerate([v for v in p])]
            back = [sum(w[j][c] * p[c] for c in range(k)) for j in range(d)]
            for j in range(d):
                for c in range(k):
                    w[j][c] -= now * x[j] * p[c]
            for c in range(k):
                b[c] -= now * p[c]
            for s, q in zip(share, bucket):
                for j in range(d):
                    e[q][j] -= now * 20 * min(s, 0.05) * back[j]
    return np.array(e), np.array(w), np.array(b), order[len(rows) - int(0.15 * len(rows)) :]


def test_training_step_of_the_language_model():
    rng = np.random.default_rng(6)
    rows = []
    for i in range(40):
        bucket = np.sort(rng.choice(60, 5, replace=False)) + 60 * (i % 3)
        rows.append(("abc"[i % 3], bucket.astype(np.int64), rng.integers(1, 5, 5).astype(np.float32)))
    model = langid.train(rows, epochs=2, rate=0.5)
    e, w, b, check = loop_training(rows, 2, 0.5)
    assert np.abs(model.embedding - e).max() < 1e-5 and np.abs(model.weights - w).max() < 1e-5 and np.abs(model.bias - b).max() < 1e-5
    # The temperature is the best of the grid, the bound the least score from which on 99 % are right.
    y = np.array(["abc".index(rows[i][0]) for i in check])
    logits = np.stack([(rows[i][2] / rows[i][2].sum()) @ (e @ w)[rows[i][1]] + b for i in check])

    def loss(t):
        p = np.exp(logits / t - (logits / t).max(axis=1, keepdims=True))
        return -np.log(p[np.arange(len(y)), y] / p.sum(axis=1)).mean()

    assert loss(model.temperature) <= min(loss(t) for t in np.geomspace(0.05, 5, 40)) + 1e-5
    p = model.probabilities(logits)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    bounds = [t for t in np.sort(top) if right[top >= t].mean() >= 0.99]
    assert model.reject_below == pytest.approx(bounds[0] if bounds else 0.0, abs=1e-6)


def test_the_pipeline_takes_odd_documents(spark, tmp_path):
    words = [f"w{k}" for k in range(400)]
    rng = np.random.default_rng(1)
    say = lambda n: " ".join(rng.choice(words, n))
    leak = say(14)
    rows = [(i, say(60)) for i in range(30)] + [(40, None), (41, ""), (42, " \n"), (43, "汉字 " * 30), (44, say(20_000)), (45, leak), (46, say(40) + " " + leak)]
    rows += [rows[3], (None, rows[4][1]), (3, rows[5][1]), (50, rows[6][1]), (51, rows[7][1] + " tail")]
    extra = "n_chars long, score double, kept boolean, component_id long, __gone long, __spans int, items int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.0, True, 5, 6, 7, 8) for i, t in rows], "doc_id long, text string, lang string, source string, " + extra)
    docs.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "sf" / "labels.parquet"))
    spark.createDataFrame([(1, leak), (2, None), (None, say(12))], "item_id long, text string").write.parquet(str(tmp_path / "sf" / "benchmark.parquet"))
    sf = str(tmp_path / "sf")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns, name
    left = {}
    for r in now.collect():
        left.setdefault(r["doc_id"], []).append(r["text"])
    assert {1, 40, 41, 42, 43, 44, 46} <= set(left) and 45 not in left
    assert left[40] == [None] and left[41] == [""] and leak not in left[46][0]
    assert 50 not in left or rows[6][1] not in left[50]  # its text stands in document 6 already
    assert corpus_pipeline.run(spark, sf).count() >= 0
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name
