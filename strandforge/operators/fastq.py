"""FASTQ operators: records are (id, name, description, sequence, quality) rows with Phred+33 quality text.

Nulls: a null sequence or quality counts as empty in statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandforge.functions import seq as S


def _text(c: str):
    return F.coalesce(F.col(c), F.lit(""))


def partial_stats(reads: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """The mergeable counters of all reads, or per group: rows of this shape may be united and merged."""
    n, q = S.seq_length(_text("sequence")), F.split(F.when(_text("quality") != "", F.col("quality")), "")
    aggs = [
        F.count(F.lit(1)).alias("total_reads"),
        F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("total_bases"),
        F.min(n).alias("min_len"),
        F.max(n).alias("max_len"),
        F.coalesce(F.sum(S.q_bases(_text("quality"), 20)), F.lit(0)).cast("bigint").alias("q20_bases"),
        F.coalesce(F.sum(S.q_bases(_text("quality"), 30)), F.lit(0)).cast("bigint").alias("q30_bases"),
        F.min(F.ascii(F.array_min(q))).alias("min_qual"),
        F.max(F.ascii(F.array_max(q))).alias("max_qual"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name) for name, c in S.base_counts(_text("sequence")).items()],
    ]
    return reads.groupBy(*groups).agg(*aggs) if groups else reads.agg(*aggs)


def merge_stats(parts: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Counters of several parts as one."""
    names = [c for c in parts.columns if c not in (groups or [])]
    kind = {"min_len": F.min, "min_qual": F.min, "max_len": F.max, "max_qual": F.max}
    aggs = [kind.get(c, F.sum)(c).alias(c) for c in names]
    return parts.groupBy(*groups).agg(*aggs) if groups else parts.agg(*aggs)


def summary(parts: DataFrame) -> DataFrame:
    """Derived figures of merged counters. Without reads lengths are 0 and qualities 33; without qualities they are 33 too."""
    bases, reads = F.col("total_bases"), F.col("total_reads")

    def pct(x):
        return F.when(bases > 0, x / F.when(bases > 0, bases) * 100.0).otherwise(0.0)

    low, high = (F.coalesce(F.col(c), F.lit(S.PHRED_OFFSET)) for c in ("min_qual", "max_qual"))
    keep = [c for c in parts.columns if c not in ("min_len", "max_len", "min_qual", "max_qual", "q20_bases", "q30_bases")]
    return parts.select(
        *keep,
        pct(F.col("q20_bases")).alias("pct_q20"),
        pct(F.col("q30_bases")).alias("pct_q30"),
        F.when(reads > 0, bases / F.when(reads > 0, reads)).otherwise(0.0).alias("avg_len"),
        F.coalesce("min_len", F.lit(0)).cast("bigint").alias("min_len"),
        F.coalesce("max_len", F.lit(0)).cast("bigint").alias("max_len"),
        low.cast("int").alias("min_qual"),
        high.cast("int").alias("max_qual"),
        F.greatest(low - S.PHRED_OFFSET, F.lit(0)).cast("int").alias("min_phred"),
        F.greatest(high - S.PHRED_OFFSET, F.lit(0)).cast("int").alias("max_phred"),
        pct(F.col("count_g") + F.col("count_c")).alias("gc_pct"),
    )


def stats(reads: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """A6 and A7 in one pass: one row, or one per group."""
    return summary(partial_stats(reads, groups))


def qualities(reads: DataFrame) -> DataFrame:
    """(id, mean_phred, q20_bases, q30_bases)."""
    q = _text("quality")
    return reads.select("id", S.mean_phred(q).alias("mean_phred"), S.q_bases(q, 20).alias("q20_bases"), S.q_bases(q, 30).alias("q30_bases"))


def revcomp(reads: DataFrame) -> DataFrame:
    """Reverse complement of the sequence with the quality reversed."""
    return reads.withColumns({"sequence": S.revcomp("sequence"), "quality": F.reverse("quality")})


def pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records of two files by place: (id, r1, r2). Names aren't compared; unequal numbers of records are an error."""
    a = first.select("id", F.struct("name", "description", "sequence", "quality").alias("r1"))
    b = second.select("id", F.struct("name", "description", "sequence", "quality").alias("r2"))
    both = a.join(b, "id", "full")
    longer = F.when(F.col("r2").isNull(), F.lit("first")).otherwise(F.lit("second"))
    bad = F.col("r1").isNull() | F.col("r2").isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("unequal record counts; longer is the "), longer, F.lit(" file")))).otherwise(F.col("r1"))
    return both.select("id", checked.alias("r1"), "r2")


def to_text(reads: DataFrame) -> DataFrame:
    """K2: one ``value`` a record in four lines."""
    desc = _text("description")
    head = F.concat(F.lit("@"), _text("name"), F.when(desc != "", F.concat(F.lit(" "), desc)).otherwise(""))
    return reads.select("id", F.concat(head, F.lit("\n"), _text("sequence"), F.lit("\n+\n"), _text("quality")).alias("value"))
