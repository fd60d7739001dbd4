"""The pipeline's stages, one by one and together."""

from collections import Counter

from graphwright.llm import decontam, mixing, queries
from tests.llm.common import corpus, frame
from tests.llm.test_joins import brute_components, shingles
from tests.llm.test_texts import brute_decontam, brute_quality


def test_stages(spark, tmp_path):
    import corpus_pipeline as P

    rows = corpus(0, 60)
    items = [(1, next(r[1] for r in rows if r[1] and len(r[1].split()) == 40)), (2, "One two three")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in P.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "sharding"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        seen.append([tuple(r) for r in out.collect()])
        docs = spark.createDataFrame(seen[-1], docs.schema)
    good = [r for r in rows if brute_quality(r[1])[-1]]
    assert Counter(seen[0]) == Counter(good)
    want = brute_components(good)
    assert sorted(r[0] for r in seen[1] if r[0] is not None and shingles(r[1])) == sorted({c for _, n, c in want if n and c is not None})
    assert Counter(seen[2]) == Counter(r for r in seen[1] if not brute_decontam(r[1], items)[-1])
    taken = {(r.doc_id, r.text): r.taken // r["size"] for r in mixing.mix(spark.createDataFrame(seen[2], docs.schema)).collect() if r["size"]}
    assert Counter((r[0], r[1]) for r in seen[3]) == +Counter(taken)
    whole = P.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in whole) == Counter(r[0] for r in seen[3])
    assert decontam.WINDOW == 13


def test_empty(spark, tmp_path):
    import corpus_pipeline as P

    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__ as E

    names = E.queries()
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.queries()) <= set(names) and "pipeline" in names
    assert set(E.oracle_sql()) <= set(names)
