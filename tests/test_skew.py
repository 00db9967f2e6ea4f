from pyspark.sql import functions as F

from strandforge.operators import skew


def test_heavy_by_the_merged_counts(spark, monkeypatch):
    """The keys that get salts don't decide which are heavy: neither none of them nor too many change the result."""
    bins = spark.createDataFrame([("c", 0, 1)] * 60 + [("d", i, 1) for i in range(200)] + [(None, 0, 1)] * 90, "chrom1 string, bin1 bigint, pair_count bigint")
    alignments = spark.createDataFrame([(0, 60)] * 30 + [(i, 1) for i in range(1, 100)] + [(-1, 0)] * 50, "ref_id int, mapq int")
    want = [("bin", "c:0"), ("ref", "0")]
    assert sorted(tuple(r) for r in skew.heavy_found(bins, alignments).collect()) == want
    for some in (F.lit(False), F.lit(True)):
        monkeypatch.setattr(skew, "heavy_keys", lambda counts, *a, some=some: counts.filter(some))
        assert sorted(tuple(r) for r in skew.heavy_found(bins, alignments).collect()) == want


def test_copies_of_one_row_are_split(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100_000).select(F.lit("c").alias("chrom1"), F.lit(0).cast("bigint").alias("bin1"), F.lit(2).cast("bigint").alias("pair_count"), F.lit("x" * 50).alias("wide")).repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    counts, total = skew.key_counts(df, ["chrom1", "bin1"])
    rows = skew.salted(df, ["chrom1", "bin1"], ["pair_count"], skew.heavy_keys(counts, 100, total), 64)
    per = [r["count"] for r in rows.groupBy("__salt").count().collect()]
    assert len(per) == 64 and max(per) < 2 * 100_000 / 64
    per = [r["count"] for r in skew.salted(df.withColumn("u", F.rand(1)), ["chrom1", "bin1"], [], skew.heavy_keys(counts, 100, total), 64, "u").groupBy("__salt").count().collect()]
    assert len(per) == 64
    got = skew.bin_totals(df)
    assert [tuple(r) for r in got.collect()] == [("c", 0, 100_000, 200_000, True)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "wide" not in plan.replace("bin1:bigint,pair_count:bigint", "")
    assert [tuple(r) for r in skew.bin_totals(df.limit(0)).collect()] == []
