from pyspark.sql import functions as F

import corpus_pipeline as p

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark, sf):
    assert [n for n, _ in p.STAGES] == ["language id", "quality rules", "near duplicates", "source mix", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in p.STAGES:
        docs = p.materialize(stage(spark, docs, sf), "test-stage")
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == DOCUMENT
        if name == "near duplicates":
            assert docs.select("doc_id").distinct().count() == docs.count()
            from storyloom.llm.neardup import near_duplicates

            assert near_duplicates(docs).where("NOT kept").count() == 0
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0 and sizes[5] > 0
    whole = p.run(spark, sf)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))


def test_stages_on_odd_documents(spark, docs, none, tmp_path):
    for df in (docs.select(*DOCUMENT), none.select(*DOCUMENT)):
        for _, stage in p.STAGES:
            df = p.materialize(stage(spark, df, str(tmp_path)), "test-odd")
        assert df.count() >= 0


def test_clashing_columns_come_through_every_stage(spark, docs):
    """Columns named like those that the stages add inside keep their values."""
    clash = "own_id copy md5 own_source times time lang_pred lang_score lang_rejected size class_id __id __copy __md5 __source __times __classes __n_words kept node key label".split()
    extra = [c for c in clash if c.lower() not in {x.lower() for x in docs.columns}]
    many = docs.select("*", *(F.lit("USER").alias(c) for c in extra))
    for name, stage in p.STAGES[:-1]:
        out = p.materialize(stage(spark, many, ""), "test-clash")
        assert out.columns == many.columns, name
        other = out.where(" OR ".join(f"`{c}` <> 'USER'" for c in extra))
        assert other.count() == 0 and out.count() <= 2 * many.count(), name
        assert out.exceptAll(many).count() == 0 or name == "source mix"
    assert p.STAGES[-1][1](spark, many, "").count() >= docs.count()
