"""Queries of problem 2 and their SQL."""

from __future__ import annotations

from strandforge.operators import skew
from strandforge.session import table

QUERIES = {
    "p2_found": lambda spark, d: skew.heavy_found(table(spark, d, "contact_bins"), table(spark, d, "alignments")),
    "p2_bin_totals": lambda spark, d: skew.bin_totals(table(spark, d, "contact_bins")),
    "p2_ref_totals": lambda spark, d: skew.ref_totals(table(spark, d, "alignments")),
}

ORACLE = {
    "p2_found": """
        select 'bin' as kind, chrom1 || ':' || cast(bin1 as varchar) as "key" from contact_bins
        where chrom1 is not null and bin1 is not null group by chrom1, bin1
        having count(*) * 100 >= (select count(*) from contact_bins)
        union all
        select 'ref', cast(ref_id as varchar) from alignments where ref_id >= 0 group by ref_id
        having count(*) * 20 >= (select count(*) from alignments)""",
    "p2_bin_totals": """
        select chrom1, bin1, count(*) as n_rows, cast(sum(pair_count) as bigint) as pair_sum,
               count(*) * 100 >= (select count(*) from contact_bins) as is_heavy
        from contact_bins where chrom1 is not null and bin1 is not null group by chrom1, bin1""",
    "p2_ref_totals": """
        select ref_id, count(*) as n_rows, cast(sum(mapq) as double) / count(mapq) as mean_mapq,
               count(*) * 20 >= (select count(*) from alignments) as is_heavy
        from alignments where ref_id >= 0 group by ref_id""",
}
