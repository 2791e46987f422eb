import importlib.util

import pytest

from tests.llm.test_operators import TEXTS, linked, quality_counts, shingle_set, table

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")


def test_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline as P

    secret = 'Token = "abcdef1234567" stands in this text of well over ten words as a plain secret does'
    texts = TEXTS + [secret]
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, " ".join(TEXTS[12].split()[:40])), (1, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r["doc_id"]: r for r in docs.collect()})
    assert not any(quality_counts(r["text"])[-1] for r in seen[0].values())
    assert all(i in seen[0] for i in range(20))
    roots = linked({i: shingle_set(r["text"], 5) for i, r in seen[0].items()}, 80, 100)
    assert set(seen[1]) == {i for i in roots if roots[i] == i}
    gone = set(seen[1]) - set(seen[2])
    assert 12 in gone and all(i in seen[2] for i in seen[1] if i not in (12,) and i < 20)
    assert seen[3][len(texts) - 1]["text"] == '[ASSIGN]" stands in this text of well over ten words as a plain secret does'
    assert set(seen[4]) == set(seen[3]) and all(r["round_trip"] for r in seen[4].values())
    assert {r["doc_id"]: r["ids"] for r in P.run(spark, str(tmp_path)).collect()} == {i: r["ids"] for i, r in seen[4].items()}
