import corpus_pipeline as P
from catalune.llm import queries


def test_stages(spark, docs):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "near-dedup", "decontamination", "mixing", "token output"] and P.ORACLE_SQL is None
    d, n = docs, []
    for name, stage in P.STAGES:
        d = stage(spark, d, "/root/testdata/sf0.001").cache()
        n.append(d.count())
        assert name == "token output" or d.columns == docs.columns
    assert docs.count() >= n[0] >= n[1] >= n[2] > 0 and n[3] == n[4]


def test_registered():
    assert sorted(k.split("_")[0] for k in queries.queries()) == sorted(f"op{i}" for i in range(1, 11))
