import corpus_pipeline
from pyspark.sql import functions as F
from latewing.llm import near_copies, quality_model, simhash
from latewing.llm.common import table


def test_stages_match_their_operators(spark, small):
    docs = table(spark, small, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, small).cache()
        seen[name] = (before, docs)
    for name in list(seen)[:-1]:
        before, after = seen[name]
        assert after.columns == before.columns and 0 < after.count() <= before.count()
    before, after = seen["quality classifier"]
    scores = quality_model.predict(before, table(spark, small, "labels")).collect()
    assert {r["doc_id"] for r in scores if r["score"] >= 0.3} == {r["doc_id"] for r in after.collect()}
    before, after = seen["simhash near-dedup"]
    groups = simhash.near_duplicates(near_copies.one_of_each(before)).collect()
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({r["component_id"] for r in groups})
    before, after = seen["line dedup"]
    assert {r["doc_id"] for r in before.collect()} == {r["doc_id"] for r in after.collect()}
    packed = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in seen["best-fit packing"][1].collect()}


def test_stages_are_the_contract_s():
    names = ["quality rules", "quality classifier", "line dedup", "simhash near-dedup", "best-fit packing"]
    assert [name for name, _ in corpus_pipeline.STAGES] == names


def test_rows_of_any_kind(spark, edge, small):
    """NULLs, empty and long texts, repeated rows and clashing columns pass every stage; so does an empty table."""
    plain = " ".join(f"{w} the and of" for w in ("one", "two", "three", "four", "five", "six", "seven", "eight")) + "."
    text = F.when(F.col("doc_id").isin(6, 8) | (F.col("doc_id").isNull() & F.col("text").isNotNull()), F.lit(plain)).otherwise(F.col("text"))
    docs = edge.withColumn("text", text)
    for start in (docs, docs.limit(0)):
        kept = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, small)
            assert kept.columns == edge.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, small).collect()
        assert len(packed) >= kept.count()
    assert kept.count() == 0
    assert {r["doc_id"] for r in corpus_pipeline.rules(spark, docs, small).collect()} <= {None, 6, 8}
