"""The pipeline's stages on the smallest table: what each may drop, and that its output is what the operators say."""

import corpus_pipeline as CP


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for i, (name, stage) in enumerate(CP.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        new = spark.read.parquet(str(tmp_path / name))
        if i < len(CP.STAGES) - 1:
            assert new.columns == columns and new.count() <= n and new.select("doc_id").distinct().count() == new.count()
            docs, n = new, new.count()
        else:
            assert new.select("doc_id").distinct().count() == n and new.count() >= n
    assert [name for name, _ in CP.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "substring_dedup", "packing"]
