"""The pipeline's SimHash stage loses no text that stands alone, and keeps one row of a group."""

import corpus_pipeline as pipeline


def test_rows_without_ids_and_repeated_ids(spark, sf_dir):
    long = ["alpha beta gamma delta epsilon zeta eta theta iota kappa", "one two three four five six seven eight nine ten", "red orange yellow green blue indigo violet black white grey", "north south east west up down left right fore aft"]
    texts = [(None, long[0]), (1, long[1]), (1, long[1]), (1, long[2]), (None, long[1]), (None, long[3]), (None, long[3]), (2, long[3])]
    rows = [(i, t, "en", "web", len(t)) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.simhash_stage(spark, docs, sf_dir).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, long[0]), (1, long[1]), (1, long[2]), (2, long[3])], key=str)
    assert pipeline.simhash_stage(spark, docs.limit(0), sf_dir).collect() == []
