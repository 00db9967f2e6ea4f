"""Alignment flag statistics (A9, A10) in one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandforge.functions import seq as S


def flags(alignments: DataFrame) -> DataFrame:
    """Id and every flag predicate."""
    return alignments.select("id", *[S.flag(n).alias(n) for n in [*S.FLAG_BITS, "is_mapped", "is_mate_mapped", "is_primary"]])


def flagstat(alignments: DataFrame) -> DataFrame:
    """One row of 16 counters. A row is secondary, else supplementary, else primary; a null flag counts in ``total`` only.

    Needs flag, ref_id, next_ref_id and mapq.
    """
    f = {n: S.flag(n) for n in [*S.FLAG_BITS, "is_mapped", "is_mate_mapped", "is_primary"]}
    both = f["is_paired"] & f["is_mapped"] & f["is_mate_mapped"]
    apart = both & (F.col("ref_id") != F.col("next_ref_id")) & (F.col("ref_id") >= 0) & (F.col("next_ref_id") >= 0)
    counters = {
        "primary": f["is_primary"],
        "secondary": f["is_secondary"],
        "supplementary": f["is_supplementary"] & ~f["is_secondary"],
        "duplicates": f["is_duplicate"],
        "primary_duplicates": f["is_duplicate"] & f["is_primary"],
        "mapped": f["is_mapped"],
        "primary_mapped": f["is_mapped"] & f["is_primary"],
        "paired_in_seq": f["is_paired"],
        "read1": f["is_paired"] & f["is_first_in_pair"],
        "read2": f["is_paired"] & f["is_second_in_pair"],
        "properly_paired": f["is_paired"] & f["is_proper_pair"] & f["is_mapped"],
        "mate_mapped": both,
        "singletons": f["is_paired"] & f["is_mapped"] & ~f["is_mate_mapped"],
        "diff_chr": apart,
        "diff_chr_mapq5": apart & (F.col("mapq") >= 5),
    }
    return alignments.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in counters.items()])


def percentages(counters: DataFrame) -> DataFrame:
    """A10: percentages of flagstat's counters: mapped of all, the others of the paired; 0 of nothing is 0."""

    def pct(part: str, whole: str):
        return F.when(F.col(whole) > 0, F.col(part) / F.when(F.col(whole) > 0, F.col(whole)) * 100.0).otherwise(0.0).alias(f"{part}_pct")

    rest = ["properly_paired", "mate_mapped", "singletons", "diff_chr", "diff_chr_mapq5"]
    return counters.select("*", pct("mapped", "total"), *[pct(c, "paired_in_seq") for c in rest])
