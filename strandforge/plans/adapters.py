"""Relations that the driver's tables stand in for: rename map, requested names, mates' references, a k-mer database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandforge.operators import hic, kmers
from strandforge.session import spread, table

K = 11


def name_map(spark: SparkSession, d: str) -> DataFrame:
    """Every indexed name gets its file in front; the row indexed last holds."""
    ord_ = F.struct("indexed_at", "byte_offset", "file_name")
    return table(spark, d, "faidx").select(F.col("name").alias("old_name"), F.concat_ws(":", "file_name", "name").alias("new_name"), ord_.alias("ord"))


def wanted(spark: SparkSession, d: str) -> DataFrame:
    """The reference names of kmer_coverage, in the order of their first statistic."""
    return table(spark, d, "kmer_coverage").select(F.col("ref_name").alias("name"), F.col("stat_id").alias("ord"))


def alignments(spark: SparkSession, d: str) -> DataFrame:
    """One row an id, with the next mate's reference (-1 without one)."""
    rows = hic.one_delivery(table(spark, d, "alignments"))
    mate = Window.partitionBy("name").orderBy("id")
    return rows.withColumn("next_ref_id", F.coalesce(F.lead("ref_id").over(mate), F.lit(-1)))


def kmer_db(spark: SparkSession, d: str, canonical: bool = False) -> DataFrame:
    """k-mers that occur at least twice in the reads."""
    return kmers.counts(spread(table(spark, d, "reads")), K, 2, canonical)
