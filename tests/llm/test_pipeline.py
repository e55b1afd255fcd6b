"""The pipeline's stages against brute force over small tables."""

import os

import pytest

import corpus_pipeline as P

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, f in P.STAGES:
        out.append(f(spark, out[-1], DATA).cache())
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard", "substring_dedup", "decontamination", "byte_bpe"]
    for df in stages[1:5]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_each_stage_by_hand(spark, stages):
    from tests.llm.test_operators import _components, _kept

    from tidewater.llm import decontamination

    rows = [sorted((r.doc_id, r.text) for r in df.collect()) for df in stages[:5]]
    assert set(rows[1]) <= set(rows[0])
    groups = _components([t for _, t in rows[1]], 5, 80, [i for i, _ in rows[1]])
    assert [i for i, _ in rows[2]] == [i for i, _, c in groups if i == c]
    kept = {i: (n, gone) for i, n, gone, _ in _kept(rows[2], 50)}
    assert {i: len((t or "").split()) for i, t in rows[3]} == {i: n - gone for i, (n, gone) in kept.items()} or all(len((t or "").encode().split()) == kept[i][0] - kept[i][1] for i, t in rows[3])
    bench = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    tokens = [decontamination.tokens(t) for t in bench]
    for i, t in rows[3]:
        h = decontamination.tokens(t)
        # a leak without any hit of a mask can't be long; planted passages have many
        whole = any(len(x) >= 9 and any((h[k : k + len(x)] == x).all() for k in range(len(h) - len(x) + 1)) for x in tokens)
        if whole:
            assert i not in {j for j, _ in rows[4]}
    assert len(rows[4]) >= 0.7 * len(rows[3])


def test_run(spark, stages):
    got = P.run(spark, DATA)
    assert got.count() == stages[4].count()
    assert got.where("n_tokens * 4 <> length(token_ids)").count() == 0
