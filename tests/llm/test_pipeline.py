"""The pipeline's stages, each on its predecessor's rows, against brute force."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from test_near_dedup import brute
from test_text_operators import brute_contamination

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, items = docs.columns, [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    extra = spark.createDataFrame([(9001, None, "en", "src1", 0), (9002, "12 !!", "en", "src1", 5), (9003, docs.first()["text"], "en", None, 5), (9004, "Съешь же ещё этих мягких булок да выпей чаю " * 6, None, "src1", 5)], docs.schema)
    docs, kept = docs.unionByName(extra), {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = [r["doc_id"] for r in docs.collect()]
        kept[name] = after
        if name == "language_id":  # the foreign text goes with the letterless ones
            assert set(after) == {i for i, t in before if any(map(str.isalpha, t or ""))} - {9004}
        elif name == "near_dedup":
            assert sorted(after) == sorted(i for i, (_, root) in brute(before, 5, 80).items() if i == root)
        elif name == "decontamination":
            assert set(after) == {i for i, t in before if not brute_contamination(t, items)[4]}
        elif name == "mixing":
            assert set(after) <= {i for i, _ in before} and len(after) > 0.5 * len(before)
        if name != "sharding":
            assert docs.columns == columns
    assert sorted(kept["mixing"]) == sorted(kept["sharding"])
    assert set(docs.columns) >= {"doc_id", "shard", "slot", *columns}


def test_run_and_entry(spark):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    assert corpus_pipeline.run(spark, SF).where("shard is null or slot is null").count() == 0


def test_edges(spark):
    """Nulls in every column, repeated rows, clashing names, and an empty table, through all stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = docs.limit(60).collect()
    clash = ["tokens", "weight", "epoch", "block", "block_order", "doc_order", "_leak", "_id", "_lot", "_key", "key", "id", "n_shingles", "shard_note"]
    columns = [*docs.columns, *clash]
    rows = [(*r, *[777] * len(clash)) for r in base + base[:5]] + [(None, base[0]["text"], None, None, None, *[777] * len(clash)), (None,) * len(columns)]
    df = spark.createDataFrame(rows, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema), *(f"{c} int" for c in clash)]))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        if name != "sharding":
            assert out.columns == columns, name
            assert out.where(" or ".join(f"{c} != 777" for c in clash)).count() == 0, name
        assert stage(spark, df.limit(0), SF).count() == 0, name
    assert corpus_pipeline.remove_near_duplicates(spark, df, SF).where("doc_id is null").count() == 2
    assert corpus_pipeline.shard(spark, df, SF).count() == len(rows)
