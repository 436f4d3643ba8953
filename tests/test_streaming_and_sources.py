from inkspan.functions.seeds import documents
from inkspan.operators import detect, score
from inkspan.sources import texts
from inkspan.streaming import scores


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    documents(spark, sf_dir).limit(60).repartition(3).write.parquet(str(tmp_path / "in"))
    query = scores.score_stream(scores.arriving(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert query.exception() is None
    docs = spark.read.parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, score.score_documents(docs, detect.all_findings(docs)).collect()))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch").distinct().count() == 3
    assert sorted(map(tuple, got.drop("batch").collect())) == want


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.json").write_text('[{"doc_id": 1, "text": "x"}, {"doc_id": 2, "text": " "}, {"doc_id": 3}]')
    assert texts.text_files(spark, str(tmp_path / "a.txt")).first().text == "one\ntwo"
    good, bad = texts.admitted(texts.json_documents(spark, str(tmp_path / "b.json")))
    assert [r.doc_id for r in good.collect()] == [1] and {(r.doc_id, r.reason) for r in bad.collect()} == {(2, "blank"), (3, "null")}
    texts.write_report(good, str(tmp_path / "r"), "documents")
    assert spark.read.json(str(tmp_path / "r")).first().row.text == "x"
