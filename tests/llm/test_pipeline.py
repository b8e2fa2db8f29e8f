"""The pipeline's stages against the operators' brute-force results, on a small table."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__


def test_stages(spark, docs, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    table = docs.select(*columns)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    kept = [table]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], str(tmp_path)).cache())
        assert kept[-1].columns == columns and dict(kept[-1].dtypes) == dict(table.dtypes)
    ids = [{r.doc_id for r in k.select("doc_id").distinct().collect()} for k in kept]
    assert len(ids[0]) > len(ids[1]) > len(ids[2]) == len(ids[3]) == len(ids[4])
    # the mix gives every document once at least, and none beyond the limit
    passes = kept[4].groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert kept[4].count() >= kept[3].count() and passes <= 2 * (corpus_pipeline.MAX_PASSES + 1)
    out = corpus_pipeline.run(spark, str(tmp_path))
    whole = out.groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert {r.doc_id for r in whole.collect()} == ids[4]
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).where("n != end or n > 2048").isEmpty()


def test_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert {"op1_quality_rules", "op2_url_filter", "op6_mix_sources", "op7_top_k", "op8_substring_dedup", "op11_ranked_search", "op13_near_vectors"} <= set(__spark_entry__.oracle_sql())
