"""Repeated passages against brute force, and the suffix sort by itself."""

import hashlib
import random

import numpy as np
import pytest

from seqlake.llm import suffix_dedup
from seqlake.llm.suffix_dedup import equal_windows, remove_repeats, without_repeats


def brute(rows, length):
    texts = sorted({(i, (t or "").encode()) for i, t in rows if i is not None})
    first, late = {}, {}
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in first:
                gone[p : p + length] = True
            else:
                first[w] = (i, p)
        late[i] = gone
    out = {}
    for i, b in texts:
        g = late[i]
        left = bytes(x for x, y in zip(b, g) if not y)
        spans = sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1]))
        out[i] = (len(b), int(g.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    piece = lambda k: "".join(r.choice("abcdeé ü\n") for _ in range(k))
    shared = [piece(r.randint(60, 260)) for _ in range(8)]
    rows = [(i, piece(r.randint(0, 300)) + "".join(r.choice(shared) + piece(r.randint(0, 40)) for _ in range(r.randint(0, 4)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "a" * 700), (n + 3, "ab" * 400), (n + 4, rows[3][1]), (n + 5, "aaaa" * 30 + "b"), (n + 6, "é" * 49 + "x"), (n + 7, "é" * 50)]
    r.shuffle(rows)
    return rows


def result(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_removed_bytes_match_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 7, b"") for i, t in rows], "doc_id long, text string, bucket long, records binary").repartition(5)
    assert result(remove_repeats(df, 100)) == brute(rows, 100)


@pytest.mark.parametrize("together,local,twins", [(10, 5, 1000), (10, 128, 3), (2000, 128, 2)])
def test_limits_of_groups_do_not_change_the_result(spark, together, local, twins):
    """A passage in all documents: crowded k-grams at its edges, one digest many times inside."""
    r = random.Random(3)
    passage = "".join(r.choice("abcdefgh") for _ in range(330))
    rows = [(i, "".join(r.choice("ijklmnop") for _ in range(80)) + passage + "".join(r.choice("qrstuvw") for _ in range(80))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(remove_repeats(df, 100, together=together, together_local=local, twins=twins)) == brute(rows, 100)


def test_bytes_decide_not_digests():
    """Records with one digest and different bytes stop the job; equal ones all but the first are late."""
    text = np.frombuffer(b"x" * 5 + b"abcdefghij" * 2 + b"abcdefghiX" + bytes(8), np.uint8)
    r = np.zeros(3, suffix_dedup.RECORD)
    r["doc"], r["at"] = [1, 1, 2], [5, 15, 0]
    late = suffix_dedup._sorted_twins(text, np.array([5, 15]), r[:2], 10)
    assert [(int(x["doc"]), int(x["at"])) for x in late] == [(1, 15)]
    with pytest.raises(RuntimeError, match="digest"):
        suffix_dedup._sorted_twins(text, np.array([5, 15, 25]), r, 10)


def test_equal_windows_are_in_suffix_order():
    r = random.Random(9)
    text = bytes(r.choice(b"ab") for _ in range(900)) * 2 + bytes(8)
    at = np.arange(len(text) - 8 - 40 + 1)
    r.shuffle(at)
    pos, group = equal_windows(np.frombuffer(text, np.uint8), at, 40, shallow=16)
    by = {}
    for p, g in zip(pos.tolist(), group.tolist()):
        by.setdefault(g, []).append(p)
    want = {}
    for p in at.tolist():
        want.setdefault(text[p : p + 40], []).append(p)
    assert sorted(sorted(v) for v in by.values()) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_repeated_rows_null_ids_empty_table_and_pipeline_form(spark):
    t = "x".join(str(i) for i in range(90))
    df = spark.createDataFrame([(1, t, 5), (1, t, 5), (2, "0 " + t, 9), (None, t, 1), (3, None, 0)], "doc_id long, text string, n_chars long")
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in remove_repeats(df).collect())
    assert got == [(-1, 0), (1, 0), (1, 0), (2, len(t)), (3, 0)]
    clash = df.withColumn("__key", df.n_chars).withColumn("__text", df.n_chars).withColumn("n_removed", df.n_chars).withColumn("kept_text", df.n_chars).withColumn("row_key", df.n_chars)
    assert without_repeats(clash).columns == clash.columns and sorted(r["__text"] for r in without_repeats(clash).collect()) == [0, 1, 5, 5, 9]
    kept = {(r["doc_id"], r["text"], r["n_chars"]) for r in without_repeats(df).collect()}
    assert kept == {(1, t, 5), (2, "0 ", 2), (None, t, 1), (3, None, 0)}
    assert remove_repeats(df.limit(0)).count() == 0
