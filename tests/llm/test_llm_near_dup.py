"""Near-duplicates against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from seqlake.llm.components import connected_components
from seqlake.llm.near_dup import keep_one_of_each, near_duplicates

SCHEMA = "doc_id long, text string, lang string, d1 long, rep string, component string"


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + width]) for i in range(len(w) - width + 1)} or ({" ".join(w)} if w else set())


def brute(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus():
    r = random.Random(5)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(3, 120))]
        for copy in range(r.randint(1, 9)):
            words = list(base)
            for _ in range(copy):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append((n, ["  ", "\n", "\t"][copy % 3].join(words)))
            n += 1
    r.shuffle(rows)
    extra = [(None, 900), ("", 901), (" \n\t ", 902), ("one", 903), ("One", 904), ("one two", 905), ("x " * 30_000, 906), ("y z", 907)]
    return rows + [(i, t) for t, i in extra]


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_components_match_brute_force(spark, width, percent):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "en", 1, "x", "y") for i, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, width, percent).collect()}
    assert got == brute(rows, width, percent)


def test_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    from seqlake.llm import near_dup

    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "SIGNATURE_BLOCK", 16)
    monkeypatch.setattr(near_dup, "PAIRS", 4)
    r = random.Random(1)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(60)] = f"n{r.randrange(300)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in near_duplicates(df, 3, 85).collect()}
    assert got == brute(rows, 3, 85)


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in near_duplicates(df).collect())
    assert got == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert sorted(r["doc_id"] or -1 for r in keep_one_of_each(df).collect()) == [-1, 1, 1]
    assert near_duplicates(df.limit(0)).count() == 0


def test_one_id_with_several_texts_and_clashing_columns(spark):
    a, b, c = "a b c d e f g h", "n o p q r s t u", "v w x y z aa bb cc"
    rows = [(5, a, 1), (5, b, 2), (5, b, 2), (3, a, 3), (9, b, 4), (9, c, 5), (2, c, 6), (7, "", 7), (8, None, 8)]
    df = spark.createDataFrame(rows, "doc_id int, text string, __gone int").withColumn("__key", F.lit(1)).withColumn("text_key", F.lit("x"))
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect())
    assert got == [(2, 2, True), (3, 3, True), (5, 3, False), (5, 5, True), (5, 5, True), (7, 7, True), (8, 8, True), (9, 2, False), (9, 5, False)]
    left = keep_one_of_each(df)
    assert left.columns == df.columns
    assert sorted((r["doc_id"], r["__gone"]) for r in left.collect()) == [(2, 6), (3, 3), (5, 2), (5, 2), (7, 7), (8, 8)]
    assert keep_one_of_each(df.limit(0)).count() == 0


def test_bucket_of_unlike_documents_with_one_boilerplate(spark, monkeypatch):
    """Half of each text is the same in all; pairs of near copies among them still meet."""
    from seqlake.llm import near_dup

    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "SIGNATURE_BLOCK", 16)
    r = random.Random(4)
    common = [f"c{i}" for i in range(80)]
    rows = []
    for i in range(60):
        own = [f"o{r.randrange(10**6)}" for _ in range(40)]
        rows.append((2 * i, " ".join(common + own)))
        rows.append((2 * i + 1, " ".join(common + own[: r.randint(25, 40)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in near_duplicates(df, 3, 85).collect()}
    assert got == brute(rows, 3, 85)


def test_components_of_chains_hubs_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
