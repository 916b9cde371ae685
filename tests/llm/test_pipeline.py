import corpus_pipeline
from pyspark.sql import functions as F

from tallyforge.session import table


def test_stages_take_effect_and_keep_columns(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    names = docs.columns
    extra = spark.createDataFrame([(10**6, None, "en", "src0", None), (10**6 + 1, "12 34", "en", None, 5)], docs.schema)
    docs = docs.unionByName(extra)
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != "token_output":
            assert docs.columns == names
        if name == "simhash_near_dedup":
            assert docs.count() == docs.select("text").distinct().count()
    assert counts[1] == counts[0] - 2 and counts[2] <= counts[1] and counts[4] == counts[5]
    last = docs.agg(F.min("start"), F.max(F.col("start") + F.col("n_tokens")), F.sum("n_tokens")).first()
    assert last[0] == 0 and last[1] == last[2]
