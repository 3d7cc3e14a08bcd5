"""The pipeline's stages, one after another, on documents whose fate is known."""

import corpus_pipeline as pipeline
from aeolia.llm.pieces import MODEL, _processor, public_tokenizers
from aeolia.llm.quality import quality


def test_stages_one_by_one(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    item = spark.read.parquet(f"{folder}/benchmark.parquet").orderBy("item_id").first().text
    ids = [r.doc_id for r in quality(docs).where("kept AND n_words BETWEEN 250 AND 500").collect()]
    good = docs.where("lang = 'en'").where(docs.doc_id.isin(ids)).orderBy("doc_id").limit(3).collect()
    turned = lambda t: " ".join(reversed(t.split()))
    new = [(9001, good[0].text + " one more"), (9002, turned(good[1].text) + "\n" + item), (9003, turned(good[2].text) + " tail password=5aaa9ac60bfe74b24b"), (9004, None), (9005, "too short")]
    more = spark.createDataFrame([(d, t, "en", "made", len(t or "")) for d, t in new], docs.schema)
    at = docs.unionByName(more)
    kept = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, at, folder)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        at = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r.doc_id for r in at.select("doc_id").collect()})
    assert not {9004, 9005} & kept[0] and {9001, 9002, 9003} <= kept[0]
    assert 9001 not in kept[1] and {9002, 9003} <= kept[1]
    assert 9002 not in kept[2] and 9003 in kept[3]
    text = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    assert "5aaa9ac60bfe74b24b" not in " ".join(r.text for r in text.values()) and all(r.n_chars == len(r.text) for r in text.values())
    made = _processor(public_tokenizers.path(MODEL))
    assert {r.doc_id: r.ids for r in at.collect()} == {d: ",".join(map(str, made.encode(r.text))) for d, r in text.items()}


def test_stages_of_nothing(spark):
    folder = "/root/testdata/sf0.001"
    empty = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
