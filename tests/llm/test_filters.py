"""The Bloom filter: what is in it always passes, and little else while it has room."""

from pyspark.sql import functions as F

from lodestone.llm import filters


def test_filter(spark):
    keys = spark.range(0, 4000, 2).select(F.xxhash64("id").alias("h"))
    rows = spark.range(20_000).withColumns({"block": F.lit("x"), "bits": F.lit(1)})
    for most, share in ((1 << 20, 0.02), (0, 1.0)):
        got = filters.tested(rows, F.xxhash64("id"), filters.bloom(keys, 2000, most), "there")
        assert got.columns == ["id", "block", "bits", "there"] and got.count() == 20_000
        assert got.where("id < 4000 and id % 2 = 0 and not there").count() == 0
        assert got.where("there and (id >= 4000 or id % 2 = 1)").count() <= share * 18_000
    assert filters.tested(rows, F.xxhash64("id"), filters.bloom(keys.limit(0), 0), "there").where("there").count() == 0
    assert filters.tested(rows.withColumn("none", F.lit(None).cast("long")), F.col("none"), filters.bloom(keys, 2000), "there").count() == 20_000
