"""The registered queries against their SQL, and the pipeline stage by stage."""

import pytest

from framewright.llm import op03_packing, op07_toxicity, op08_decontaminate, registry
from tests.oracle import same

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, name):
    same(registry.queries()[name](spark, sf_dir), SQL[name], sf_dir)


def test_held_out_toxicity(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = op07_toxicity.op7_toxicity(spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    rows = got.select("toxic", "predicted").collect()
    hits = sum(r.toxic and r.predicted for r in rows)
    assert hits >= 0.9 * sum(r.toxic for r in rows) and sum(r.predicted and not r.toxic for r in rows) <= 0.02 * len(rows)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, clean = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clean, sf_dir).cache()
        assert out.columns == columns, name
        assert out.count() <= clean.count()
        clean = out
    assert op08_decontaminate.decontaminate(clean, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, clean, sf_dir)
    assert packed.select("doc_id").distinct().count() == clean.count()
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert op03_packing.CAPACITY == 4096


def test_pipeline_on_hostile_clashing_and_empty_tables(spark, sf_dir):
    import corpus_pipeline

    extra = ["_key", "_id", "_secret_key", "key", "found", "row", "id", "n", "h", "token", "label", "value", "text_key", "component_id", "a.b"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    long = " ".join(f"word{k}" for k in range(30_000))
    texts = [(0, None), (1, ""), (2, " \n "), (None, "no id here at all my friend"), (3, "x" * 300_000), (4, long), (5, long + " end"), (6, "same text of six plain words"), (6, "same text of six plain words"), (7, "same text of six plain words"), (8, None), (8, None)]
    rows = [(i, t, None, "s", None if t is None else len(t), *(f"{c} of {k}" for c in extra)) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, docs.limit(0), sf_dir)
        assert none.columns == docs.columns and none.count() == 0, name
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == none.columns, name
        docs = docs.cache()
        kept = docs.collect()
        for r in kept:
            at = {r[c].rsplit(" ", 1)[1] for c in extra}
            assert len(at) == 1 and [r[c] for c in extra] == [f"{c} of {next(iter(at))}" for c in extra], name
            assert (r.doc_id, r.text) == texts[int(next(iter(at)))], name
        if name == "near_duplicates":
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted((i is None, i or 0) for i in (0, 1, 2, None, 3, 4, 6, 8, 8))
    assert len(kept) == 9
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == 8 and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0
