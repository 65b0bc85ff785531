import corpus_pipeline
import pytest
from graphloom.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_over_odd_documents(spark, make_docs, odd_texts, prose, tmp_path):
    docs = make_docs(prose + odd_texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(prose[0][0], 1, 0), (prose[1][0], 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, str(tmp_path)).checkpoint()
        assert docs.columns == list(corpus_pipeline.COLUMNS) and 0 < docs.count() <= before, name
    ids = {r.doc_id for r in docs.collect()}
    assert not {1, 2, 3} & ids and 4 in ids and None in ids
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0


def test_run(spark):
    pieces = corpus_pipeline.run(spark, SF)
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0.5 * documents.count() < pieces.select("doc_id").distinct().count() <= documents.count()


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n.startswith("op")])
def test_queries_return_their_columns(spark, name):
    columns = {
        "op1_": "doc_id held_out score predicted",
        "op2_": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op3_": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
        "op4_": "vec_id n_links component_id kept",
        "op5_": "doc_id held_out lang_pred score",
        "op6_": "doc_id n_words n_removed kept_sha256",
        "op7_": "",
        "op8_": "doc_id n_shingles component_id",
        "op9_": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        "op10": "doc_id held_out score predicted",
    }[name[:4]]
    df = queries.QUERIES[name](spark, SF)
    assert set(columns.split()) <= set(df.columns)
    n = spark.read.parquet(f"{SF}/{'embeddings' if name.startswith('op4') else 'documents'}.parquet").count()
    assert df.count() == n or name.startswith(("op9", "op7"))
