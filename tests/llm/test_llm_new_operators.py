"""Spelling variants, mixtures and hard negatives against plain versions; words and pages that used to break."""

import math
import random
import re
import time
import zlib

import numpy as np
import pytest

from seqlake.llm import decontaminate, hard_negatives, html_extract, mixing, near_dup, spelling
from seqlake.llm.text_arrays import same_spans, word_hash

# ------------------------------------------------------------ spelling variants


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, ratio=2):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    root = {}
    for w in counts:
        at = w
        while form[at] is not None:
            at = form[at]
        root[w] = at
    return {w: (form[w], root[w], counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def brute_words(rows, least_length=5, least_count=3, every=97):
    n = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] = n.get(run, 0) + 1
    return {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}


def got_variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("candidates", [1, 4, 1024])
def test_variants_of_alike_words(spark, monkeypatch, candidates):
    """Small alphabets put many words behind each chunk; whatever splits them, no pair is lost."""
    monkeypatch.setattr(spelling, "near_pairs", lambda words, f=spelling.near_pairs: f(words, candidates))
    r = random.Random(candidates)
    words = {"".join(r.choice("abé") for _ in range(r.randint(1, 9))) for _ in range(260)} | {"x", "y", "a" * 300, "a" * 299, "a" * 150 + "b" + "a" * 149}
    counts = {w: r.choice([1, 2, 3, 4, 8, 16, 50]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.variants(df).collect()
    assert len(got) == len(counts)
    assert {x["word"]: (x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in got} == brute_variants(counts)


def test_spelling_of_texts(spark):
    r = random.Random(5)
    base = ["Wordes", "wordés", "ÀÉther", "straße", "tree", "branches", "BRANCHED", "brunches", "x" * 400]
    rows = [(i, " ".join(r.choice(base) + r.choice(["", "s", "!", "1"]) for _ in range(r.randint(0, 60)))) for i in range(120)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (900, None), (901, ""), (902, "1 2 ._-"), (903, "words " * 30_000)]
    df = spark.createDataFrame([(i, t, 1, "w", 2) for i, t in rows], "doc_id long, text string, n int, word string, root int")
    counts = brute_words(rows, every=7)
    assert len(counts) > 20
    assert got_variants(spelling.spelling_variants(df, typo_every=7)) == brute_variants(counts)
    assert spelling.spelling_variants(df.limit(0)).count() == 0
    assert spelling.near_pairs(spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("",), ("ab",)], "word string")).count() == 3


# --------------------------------------------------------------------- mixtures


def brute_targets(sizes, weights=(1, 2, 3), epochs=3):
    """Rounds of sharing out, as one would by hand."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(epochs * sizes[s] for s in full)
        share = {s: epochs * sizes[s] if s in full else left * w[s] / sum(w[x] for x in names if x not in full) for s in names}
        more = {s for s in names if s not in full and share[s] > epochs * sizes[s] * (1 + 1e-12)}
        if not more:
            return share
        full |= more


def words_in(text):
    return re.findall(r"[^ \t-\r]+", text or "")


@pytest.mark.parametrize("rows_a_range", [3, 4000])
def test_mixture(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", rows_a_range)
    r = random.Random(4)
    say = lambda n: "".join(f"w{r.randint(0, 9)}{r.choice([' ', chr(10), '  ', chr(0xA0)])}" for _ in range(n))
    share = {"a": 3, "B": 200, "é": 25, "z": 4, None: 9, "hot": 120, "empty": 5}
    rows = [(i, None if r.random() < 0.1 else say(0 if s == "empty" else r.randint(0, 30)), s) for i, s in enumerate(s for s, n in share.items() for _ in range(n))]
    rows += [rows[10], rows[10], (None, say(7), "B"), (rows[11][0], say(5), "B"), (7777, "w " * 50_000, "hot")]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, source string, size int, target int")
    got = mixing.mix(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words_in(t))
    want = brute_targets(sizes)
    assert sorted((str(x["doc_id"]), x["size"], str(x["source"])) for x in got) == sorted((str(i), len(words_in(t)), str(s)) for i, t, s in rows)
    taken = {}
    for x in got:
        assert x["source_size"] == sizes[x["source"]] and math.isclose(x["target"], want[x["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= x["taken"] <= 3 * x["size"] and x["taken"] == x["passes"] * x["size"] + x["last"]
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
    assert all(taken[s] == math.floor(want[s] + 0.5) for s in want)
    # Cut in one place of the order: in each source one document at most is taken in part in its last pass.
    for s in sizes:
        assert sum(0 < x["last"] < x["size"] for x in got if x["source"] == s) <= 1
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    texts = mixing.mixed_texts(df, mixing.mix(df)).collect()
    out = {}
    for x in texts:
        out[x["source"]] = out.get(x["source"], 0) + len(words_in(x["text"]))
    assert out == {s: n for s, n in taken.items() if n}
    assert mixing.mix(df.limit(0)).count() == 0
    assert [x["taken"] for x in mixing.mix(df.where("text is null")).collect()] == [0] * sum(t is None for _, t, _ in rows)


# --------------------------------------------------------------- hard negatives


def brute_negatives(rows, positives=5, negatives=3, every=50, scale=256):
    v = [(i, lab, [math.floor(scale * float(np.float32(x))) for x in e]) for i, e, lab in rows if i is not None and lab is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, lab, a in v:
        if i % every:
            continue
        score = [(-sum(x * y for x, y in zip(a, b)), j, other) for j, other, b in v if len(b) == len(a)]
        for ps, p, _ in sorted(x for x in score if x[2] == lab and x[1] != i)[:positives]:
            fine = sorted((ns, n) for ns, n, other in score if other != lab and 50 * -ps <= 100 * -ns <= 95 * -ps)[:negatives]
            out += [(i, p, k + 1, n, -ps, -ns) for k, (ns, n) in enumerate(fine)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(hard_negatives, "COMPONENTS", 6 * 40)
        monkeypatch.setattr(hard_negatives, "ANCHORS_LEAST", 3)
        monkeypatch.setattr(hard_negatives, "DEPTH", 2)
    rng = np.random.default_rng(7)
    label = [0 if i % 3 == 0 else int(rng.integers(0, 4)) for i in range(300)]  # one label holds a third
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 6)], label[i]) for i in range(300)]
    rows[40:52] = [(i, rows[40][1], label[i]) for i in range(40, 52)]  # equal vectors: ties of scores
    rows += [rows[20], rows[20], rows[30], rows[31], (31, rows[5][1], 2)]  # repeated rows, an anchor among them; one id with two vectors
    rows += [(400, None, 1), (410, [0.1, None] + [0.0] * 4, 1), (420, [float("nan")] + [0.0] * 5, 1), (430, [float("inf")] + [0.0] * 5, 1), (440, [], 1), (450, [0.5, 0.5], 1), (451, [0.5, 0.4], 1), (452, [0.25, 0.4], 2), (460, rows[3][1], None), (None, rows[3][1], 1), (470, [0.0] * 6, 3)]
    df = spark.createDataFrame([(*x, 5, 6) for x in rows], "vec_id long, embedding array<float>, label int, rank int, anchor_id int")
    got = sorted(tuple(x) for x in hard_negatives.mine(df, every=10).collect())
    want = brute_negatives(rows, every=10)
    assert len(want) > 200 and got == want
    assert hard_negatives.mine(df.limit(0)).count() == 0


def test_threshold_stops_before_the_end_and_ties_do_not_stop_it():
    rng = np.random.default_rng(1)
    v = rng.integers(-300, 300, (4000, 3))
    v[100:160] = v[100]
    lists = hard_negatives.SortedLists(np.arange(4000), v)
    for q in range(0, 4000, 200):
        s = v @ v[q]
        top = int(s.max())
        windows = [(-(1 << 62), 1 << 62), (top // 2, top * 9 // 10), (top + 1, top + 5)]
        for (low, high), (rows, score) in zip(windows, lists.best(v[q], np.arange(4000) != q, windows, 3)):
            want = sorted((-int(s[j]), j) for j in range(4000) if j != q and low <= s[j] <= high)[:3]
            assert list(zip((-score).tolist(), rows.tolist())) == want
    assert lists.scored < 0.9 * 20 * 4000
    big = hard_negatives.SortedLists(np.array([0, 1, 2]), np.array([[3 * 10**14, 1], [3 * 10**14, 2], [3 * 10**14, 3]]))
    [(rows, score)] = big.best(np.array([3 * 10**14, 1]), np.array([False, True, True]), [(-(1 << 62), 10**40)], 1)
    assert rows.tolist() == [2] and int(score[0]) == 9 * 10**28 + 3


# ------------------------------------------------------- words that look alike


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_word_hash_and_bytes():
    r = random.Random(2)
    texts = [b"", b"a", b"a\0", b"a" * 7, b"a" * 8, b"a" * 9, b"a" * 256, b"a" * 257, *(bytes(r.choice(b"ab") for _ in range(r.randint(1, 40))) for _ in range(300))]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    h = word_hash(data, starts, ends)
    assert len(set(h.tolist())) == len(set(texts)) and (h != word_hash(data, starts, ends, 1)).all()
    a, b = np.array([(i, j) for i in range(len(texts)) for j in range(0, len(texts), 7)]).T
    assert same_spans(data, starts[a], ends[a], data, starts[b], ends[b]).tolist() == [texts[i] == texts[j] for i, j in zip(a, b)]


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096, 8192])
def test_long_words_that_look_alike_stay_apart(spark, n):
    a, b = thue_morse(n), thue_morse(n, "ba")
    df = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df, 3, 85).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (1, False)}
    assert sorted(r["doc_id"] for r in near_dup.keep_one_of_each(df).collect()) == [1, 2]
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    assert {r["doc_id"]: r["contaminated"] for r in decontaminate.contamination_report(df, bench, 10).collect()} == {1: True, 2: False, 3: True}
    assert [tuple(r) for r in decontaminate.decontaminate(df, bench, 10).collect()] == [(2, b)]


def test_equal_hashes_are_told_apart_by_their_bytes(spark, monkeypatch):
    """With a hash of three values nearly every word meets others; items take another seed, documents the bytes."""
    monkeypatch.setattr(decontaminate, "word_hash", lambda d, s, e, seed=0, f=word_hash: f(d, s, e, seed) % np.uint64(7))
    items = [(1, "one two three"), (2, "four five")]
    r = random.Random(3)
    say = ["one two three", "four five", "x two three", "one two", "five four", "six seven eight", *(" ".join(r.choice("one two three four five six seven".split()) for _ in range(12)) for _ in range(40))]
    index = decontaminate.Index(items, 10)
    assert len(index.vocabulary) == 5
    from seqlake.llm.text_arrays import text_bytes
    import pyarrow as pa

    found = index.hits(decontaminate.words_of(*text_bytes(pa.array(say))))
    assert {k for k in found} == {k for k, t in enumerate(say) if re.search(r"\bone two three\b|\bfour five\b", t)}


@pytest.mark.parametrize("limit", [None, 20])
def test_decontaminate_lets_any_column_pass(spark, monkeypatch, limit):
    if limit:
        monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", limit)
    bench = spark.createDataFrame([(1, "one two three four"), (2, "five six seven eight nine")], "item_id long, text string")
    names = ["__spans", "__id", "__row", "spans_0", "id_0", "row_0", "items", "doc", "row_key"]
    df = spark.createDataFrame([(1, "a b c d e f one two three four", *range(9)), (2, None, *range(9))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = sorted((tuple(r) for r in decontaminate.decontaminate(df, bench, 4).collect()), key=str)
    assert got == [(1, "a b c d e f ", *range(9)), (2, None, *range(9))]


# ------------------------------------------------------------------ broken pages


@pytest.mark.parametrize(
    "make",
    [
        lambda n: '<a "' * (n // 4), lambda n: "<div>" * (n // 10) + "</span>" * (n // 14) + "</b></i>" * (n // 10), lambda n: "<!" * (n // 2), lambda n: "<a " * (n // 3), lambda n: "<script/>" * (n // 9),
        lambda n: "<div>" * (n // 12) + "<header>" * (n // 16), lambda n: "<ul>" + "<div>" * (n // 20) + "<li>" * (n // 8), lambda n: "<p><td>" + "<b>" * (n // 8) + "<hr>" * (n // 8), lambda n: "<title" * (n // 6) + ' ">',
        lambda n: "<a \"'>" * (n // 6), lambda n: "<p>x &#" + "9" * n + ";", lambda n: "<b><i>" * (n // 12) + "</u>" * (n // 8),
    ],
)
def test_broken_pages_take_linear_time(make):
    html_extract.main_text(make(1000))
    began = time.process_time()
    html_extract.main_text(make(1_000_000))
    assert time.process_time() - began < 20


def test_broken_pages_keep_their_text():
    t = html_extract.main_text
    assert t("<body><p>1 < 2 and <b>bold</b> <a \"x") == '1 < 2 and bold <a "x'
    assert t("<p>a &#65; &#0065; &#x41; &#x000041; &#" + "1" * 9000 + "; &#x" + "f" * 9000 + "; &#0; &#0a</p>") == "a A A A A � � � �a"
    assert t("<p>" + "&#" + "0" * 9000 + "65;</p>") == "A"
