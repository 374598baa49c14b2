from pathlib import Path

import corpus_pipeline
from warraq.llm import queries

SMALL = "/root/testdata/sf0.001"


def test_stages_on_odd_documents(spark, odd, empty, tmp_path):
    for name, start in (("odd", odd), ("empty", empty)):
        docs, kept = start, [start.count()]
        for k, (stage, run) in enumerate(corpus_pipeline.STAGES):
            run(spark, docs, SMALL).write.parquet(str(tmp_path / name / str(k)))
            out = spark.read.parquet(str(tmp_path / name / str(k)))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, stage
                kept.append(out.count())
            docs = out
        assert kept == sorted(kept, reverse=True)


def test_pipeline_decides_as_its_operators_do(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = corpus_pipeline.language_id(spark, docs, SMALL)
    assert first.count() == docs.count()
    second = corpus_pipeline.quality(spark, first, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    lost = docs.join(second, "doc_id", "left_anti").join(labels, "doc_id").filter("quality = 1").count()
    assert lost <= 0.05 * labels.filter("quality = 1").count()
    third = corpus_pipeline.near_duplicate_join(spark, second, SMALL)
    from warraq.llm import near_duplicates

    assert third.count() == near_duplicates.linked_documents(second).select("class_id").distinct().count()
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(rows.columns)


def test_every_operator_has_its_query():
    numbers = sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] and Path(corpus_pipeline.__file__).name == "corpus_pipeline.py"
