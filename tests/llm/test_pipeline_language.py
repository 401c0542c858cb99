"""The pipeline's language stage: prediction and score decide, not only letters."""

import corpus_pipeline
from limnos.llm import language_id
from limnos.llm.queries import held_out

SF = "/root/testdata/sf0.001"
OTHER = {
    9001: "Съешь же ещё этих мягких французских булок да выпей чаю " * 5,
    9002: "これは日本語の文章です" * 9,
    9003: "Zxqvbn gkfjw pqltr mnbvc xzlkj hgfds qpwoe " * 6,
    9004: "12 !!",
    9005: None,
}


def test_prediction_and_score_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r["doc_id"] for r in docs.collect()}
    extra = spark.createDataFrame([(i, t, None, "src1", 0) for i, t in OTHER.items()], docs.schema)
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(extra), SF)
    assert {r["doc_id"] for r in kept.collect()} == ids
    # An undecided network keeps nothing, whatever its prediction.
    model = language_id.train(docs.where(~held_out()), reject=True)
    scored = {r["doc_id"] for r in language_id.identify(docs, model).where("lang_pred != 'und' and score >= 0.9").collect()}
    assert {r["doc_id"] for r in language_id.in_learned_language(docs, model, floor=0.9).collect()} == scored < ids


def test_without_labels(spark):
    rows = [(1, "words", None), (2, "12 !!", None), (3, None, None), (4, "", None), (5, "日本", None)]
    df = spark.createDataFrame([(i, t, g, "s", 0) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars int")
    assert sorted(r["doc_id"] for r in corpus_pipeline.identify_language(spark, df, SF).collect()) == [1, 5]
