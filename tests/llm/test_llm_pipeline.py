"""The pipeline's stages, each on its own input, against plain versions."""

import os

import pytest

import corpus_pipeline
from seqlake.llm.cut import cut

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_stages_in_order(spark):
    from test_llm_near_dup import brute as near
    from test_llm_suffix import brute as repeats
    from test_llm_text import brute_hits

    from seqlake.llm import quality

    base = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-dedup", "suffix-array dedup", "decontamination", "packing"]
    stages = [f for _, f in corpus_pipeline.STAGES]
    before = {r["doc_id"]: r for r in base.collect()}

    good = cut(stages[0](spark, base, DATA), "t")
    model = quality.fit(base, spark.read.parquet(f"{DATA}/labels.parquet"))
    want = {r["doc_id"] for r in quality.score_quality(base, model).where("predicted = 1").collect()}
    got = {r["doc_id"]: r for r in good.collect()}
    assert set(got) == want and all(got[i] == before[i] for i in got) and good.columns == base.columns

    one = cut(stages[1](spark, good, DATA), "t")
    kept = {i for i, (_, _, k) in near([(i, r["text"]) for i, r in got.items()], 5, 80).items() if k}
    rows = {r["doc_id"]: r for r in one.collect()}
    assert set(rows) == kept and all(rows[i] == before[i] for i in rows)

    clean = cut(stages[2](spark, one, DATA), "t")
    lost = repeats([(i, r["text"]) for i, r in rows.items()], 100)
    after = {r["doc_id"]: r for r in clean.collect()}
    assert set(after) == kept and clean.columns == base.columns
    for i, r in after.items():
        assert (r["text"] == rows[i]["text"]) == (lost[i][1] == 0) and abs(len(r["text"].encode()) - (lost[i][0] - lost[i][1])) <= 6 * lost[i][2]

    fair = cut(stages[3](spark, clean, DATA), "t")
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    left = {r["doc_id"]: r["text"] for r in fair.collect()}
    for i, r in after.items():
        n, hit, *_ = brute_hits(r["text"], items, 10)
        assert (i in left) == (hit <= 0.5 * n)
        if i in left:
            assert (left[i] == r["text"]) == (hit == 0)

    packed = stages[4](spark, fair, DATA).collect()
    assert {r["doc_id"] for r in packed} == set(left)
    assert corpus_pipeline.run(spark, DATA).count() == len(packed)
