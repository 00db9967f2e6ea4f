"""Hi-C contacts: consecutive mates, pair filters, binned contact matrix.

Mates are neighbours in file order: primary records of equal name pair up two by two within a run, (1, 2), (3, 4), ...; an odd
last one stays alone, and a pair that fails a filter is used up. This needs the record before and the place in the run, not
groups by name. Records are cut into blocks of consecutive ids; what crosses a block's border (number of records, last
record, start of the last run) is carried over in a table of one row a block, which is worked through in groups of blocks. A name that
holds a third of all rows is so no hot key, and one shuffle of the records, by block, is enough.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandforge.functions import seq as S
from strandforge.session import materialised

#: Ids a block. What crosses borders is one row a block, so blocks may be small.
BLOCK = 50_000
#: Blocks a group, for what is carried over borders: 1e12 records are 2e7 blocks in 2,000 groups.
WIDE = 10_000


@dataclass(frozen=True)
class PairFilter:
    """Limits for both mates; None switches a limit off, and a null nm or as_score passes."""

    min_mapq: int = 30
    max_nm: int | None = 5
    min_as: int | None = 100


def one_delivery(alignments: DataFrame) -> DataFrame:
    """One row an id: of several the largest by all columns."""
    row = F.struct("name", "flag", "ref_id", "pos", "mapq", "nm", "as_score")
    return alignments.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max(row).alias("__r")).select("id", "__r.*")


def _carry(ends: DataFrame, own: list[str], wide: int) -> DataFrame:
    """For each block the last record of the blocks before it in its file, and their number of records.

    ``ends`` has one row a block. Blocks are cut into groups of ``wide`` blocks; windows run within groups, and over one row a
    group, so no task orders all blocks.
    """
    group = F.floor(F.col("b") / wide).alias("g")
    ends = ends.select(*own, group, "b", "rows", "last")
    inner, outer = Window.partitionBy(*own, "g").orderBy("b"), Window.partitionBy(*own).orderBy("g")
    tops = ends.groupBy(*own, "g").agg(F.sum("rows").alias("g_rows"), F.max_by("last", "b").alias("g_last"))
    tops = tops.select(*own, "g", F.lag("g_last").over(outer).alias("g_carried"), (F.sum("g_rows").over(outer) - F.col("g_rows")).alias("g_offset"))
    inside = ends.select(*own, "g", "b", F.lag("last").over(inner).alias("carried"), (F.sum("rows").over(inner) - F.col("rows")).alias("offset"))
    both = inside.join(tops, [*own, "g"])
    return both.select(*own, "b", F.coalesce("carried", "g_carried").alias("carried"), (F.col("offset") + F.col("g_offset")).alias("offset"))


def _run_before(starts: DataFrame, own: list[str], wide: int) -> DataFrame:
    """For each block the start of the run that its first record may continue, by the same two levels."""
    starts = starts.select(*own, F.floor(F.col("b") / wide).alias("g"), "b", "s")
    before = lambda w: F.max("s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    inside = starts.select(*own, "g", "b", before(Window.partitionBy(*own, "g").orderBy("b")).alias("r"))
    tops = starts.groupBy(*own, "g").agg(F.max("s").alias("s")).select(*own, "g", before(Window.partitionBy(*own).orderBy("g")).alias("top"))
    return inside.join(tops, [*own, "g"]).select(*own, "b", F.coalesce("r", "top").alias("run_before"))


def mates(alignments: DataFrame, block: int = BLOCK, wide: int = WIDE) -> DataFrame:
    """(pair_id, m1, m2) of consecutive primary records, before any filter; pair_id is the second mate's id.

    ``id`` must be unique; its order is the file's order. With a column ``file`` no pair or run crosses from one file into
    another. Null names pair with nothing. m1 and m2 are structs.
    """
    own = ["__file"] if "file" in alignments.columns else []
    rec = F.struct("id", "name", "flag", "ref_id", "pos", "mapq", "nm", "as_score")
    prim = alignments.filter(S.flag("is_primary"))
    prim = prim.select(*[F.coalesce("file", F.lit("")).alias(c) for c in own], F.floor(F.col("id") / block).alias("b"), F.col("id"), rec.alias("r"))
    keys = [*own, "b"]
    inside = Window.partitionBy(*keys).orderBy("id")
    rows = prim.withColumns({"n": F.row_number().over(inside), "before": F.lag("r").over(inside)})

    # one row a block, written once, as both levels read it
    blocks = materialised(prim.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.max_by("r", "id").alias("last")), "mates-blocks")
    ends = _carry(blocks, own, wide)
    rows = rows.join(ends, keys).select(*keys, "id", "r", F.coalesce("before", "carried").alias("p"), (F.col("offset") + F.col("n")).alias("pid"))
    rows = rows.withColumn("start", F.when(F.coalesce(F.col("p.name") == F.col("r.name"), F.lit(False)), None).otherwise(F.col("pid")))

    starts = _run_before(materialised(rows.groupBy(*keys).agg(F.max("start").alias("s")), "mates-runs"), own, wide)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(starts, keys).withColumn("run", F.coalesce(F.max("start").over(upto), "run_before"))
    return rows.filter((F.col("pid") - F.col("run")) % 2 == 1).select(F.col("id").alias("pair_id"), F.col("p").alias("m1"), F.col("r").alias("m2"))


def _passes(m: str, f: PairFilter):
    ok = (F.col(f"{m}.flag").bitwiseAND(0x404) == 0) & (F.col(f"{m}.ref_id") >= 0) & (F.col(f"{m}.pos") >= 0) & (F.col(f"{m}.mapq") >= f.min_mapq)
    if f.max_nm is not None:
        ok = ok & F.coalesce(F.col(f"{m}.nm") <= f.max_nm, F.lit(True))
    if f.min_as is not None:
        ok = ok & F.coalesce(F.col(f"{m}.as_score") >= f.min_as, F.lit(True))
    return ok


def contacts(alignments: DataFrame, refs: DataFrame, limits: PairFilter = PairFilter(), block: int = BLOCK) -> DataFrame:
    """(pair_id, chrom1, pos1, chrom2, pos2) of the pairs that pass; ref_ids outside the dictionary drop out."""
    kept = mates(alignments, block).filter(_passes("m1", limits) & _passes("m2", limits))
    kept = kept.select("pair_id", F.col("m1.ref_id").alias("r1"), F.col("m1.pos").alias("pos1"), F.col("m2.ref_id").alias("r2"), F.col("m2.pos").alias("pos2"))
    for i in "12":
        names = refs.select(F.col("ref_id").alias(f"r{i}"), F.col("name").alias(f"chrom{i}"))
        kept = kept.join(names, f"r{i}")
    return kept.select("pair_id", "chrom1", F.col("pos1").cast("bigint").alias("pos1"), "chrom2", F.col("pos2").cast("bigint").alias("pos2"))


def binned(found: DataFrame, bin_size: int) -> DataFrame:
    """Contacts with the bins of both ends, the smaller (chromosome, bin) first."""
    a = F.struct(F.col("chrom1").alias("c"), S.bin_start("pos1", bin_size).alias("b"))
    b = F.struct(F.col("chrom2").alias("c"), S.bin_start("pos2", bin_size).alias("b"))
    both = found.select("pair_id", F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))
    return both.select("pair_id", F.col("x.c").alias("chrom1"), F.col("x.b").alias("bin1"), F.col("y.c").alias("chrom2"), F.col("y.b").alias("bin2"))


def matrix(bins: DataFrame) -> DataFrame:
    """Pairs per key; sort by the key (O2) when it is written."""
    return bins.groupBy("chrom1", "bin1", "chrom2", "bin2").agg(F.count(F.lit(1)).alias("count"))


def merge_partials(parts: DataFrame, count: str = "pair_count") -> DataFrame:
    """Partial matrices as one; null keys are keys."""
    return parts.groupBy("chrom1", "bin1", "chrom2", "bin2").agg(F.sum(count).alias("count"))


def summary(bins: DataFrame) -> DataFrame:
    """One row: pairs, those within and between chromosomes with percentages, and populated bins."""
    per = bins.groupBy("chrom1", "bin1", "chrom2", "bin2").agg(F.count(F.lit(1)).alias("n"))
    one = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_pairs"),
        F.coalesce(F.sum(F.when(F.col("chrom1") == F.col("chrom2"), F.col("n"))), F.lit(0)).cast("bigint").alias("intra_pairs"),
        F.count(F.lit(1)).alias("populated_bins"),
    )
    total = F.when(F.col("total_pairs") > 0, F.col("total_pairs"))
    inter = F.col("total_pairs") - F.col("intra_pairs")
    return one.select(
        "total_pairs", "intra_pairs", inter.alias("inter_pairs"), "populated_bins",
        F.coalesce(F.col("intra_pairs") * 100.0 / total, F.lit(0.0)).alias("intra_pct"), F.coalesce(inter * 100.0 / total, F.lit(0.0)).alias("inter_pct"),
    )
