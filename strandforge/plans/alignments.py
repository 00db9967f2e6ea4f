"""Queries of the alignment and Hi-C operators and their SQL."""

from __future__ import annotations

from strandforge.functions import seq as S
from strandforge.operators import flagstat, hic
from strandforge.plans import adapters
from strandforge.session import table

BIN = 10_000
LIMITS = hic.PairFilter()


def _rows(spark, d):
    return hic.one_delivery(table(spark, d, "alignments"))


def _contacts(spark, d):
    return hic.contacts(_rows(spark, d), table(spark, d, "bam_refs"), LIMITS)


def _mates(spark, d):
    from pyspark.sql import functions as F

    return hic.mates(_rows(spark, d)).select("pair_id", F.col("m1.id").alias("id1"), F.col("m2.id").alias("id2"))


QUERIES = {
    "bam_flags": lambda spark, d: flagstat.flags(_rows(spark, d)),
    "bam_flagstat": lambda spark, d: flagstat.flagstat(adapters.alignments(spark, d)),
    "bam_flagstat_pct": lambda spark, d: flagstat.percentages(flagstat.flagstat(adapters.alignments(spark, d))),
    "hic_mates": _mates,
    "hic_pairs": _contacts,
    "hic_contact_matrix": lambda spark, d: hic.matrix(hic.binned(_contacts(spark, d), BIN)).orderBy("chrom1", "bin1", "chrom2", "bin2"),
    "hic_summary": lambda spark, d: hic.summary(hic.binned(_contacts(spark, d), BIN)),
    "hic_merge_partials": lambda spark, d: hic.merge_partials(table(spark, d, "contact_bins")),
}

_A = "(select distinct id, name, flag, ref_id, pos, mapq, nm, as_score from alignments)"
_NAMES = {**{n: f"flag & {b} <> 0" for n, b in S.FLAG_BITS.items()}, "is_mapped": "flag & 4 = 0", "is_mate_mapped": "flag & 8 = 0", "is_primary": "flag & 2304 = 0"}
_FLAG = {n: f"({c.replace('flag &', '(flag &').replace(' <>', ') <>').replace(' = 0', ') = 0')})" for n, c in _NAMES.items()}


def _if(c: str) -> str:
    return f"count(*) filter (where {c})"


_BOTH = f"{_FLAG['is_paired']} and {_FLAG['is_mapped']} and {_FLAG['is_mate_mapped']}"
_APART = f"{_BOTH} and ref_id <> next_ref_id and ref_id >= 0 and next_ref_id >= 0"
_P = _FLAG["is_paired"]
_STAT = f"""select count(*) as total, {_if(_FLAG['is_primary'])} as "primary", {_if(_FLAG['is_secondary'])} as secondary,
    {_if(_FLAG['is_supplementary'] + ' and not ' + _FLAG['is_secondary'])} as supplementary, {_if(_FLAG['is_duplicate'])} as duplicates,
    {_if(_FLAG['is_duplicate'] + ' and ' + _FLAG['is_primary'])} as primary_duplicates, {_if(_FLAG['is_mapped'])} as mapped,
    {_if(_FLAG['is_mapped'] + ' and ' + _FLAG['is_primary'])} as primary_mapped, {_if(_P)} as paired_in_seq,
    {_if(_P + ' and ' + _FLAG['is_first_in_pair'])} as read1, {_if(_P + ' and ' + _FLAG['is_second_in_pair'])} as read2,
    {_if(_P + ' and ' + _FLAG['is_proper_pair'] + ' and ' + _FLAG['is_mapped'])} as properly_paired, {_if(_BOTH)} as mate_mapped,
    {_if(_P + ' and ' + _FLAG['is_mapped'] + ' and not ' + _FLAG['is_mate_mapped'])} as singletons, {_if(_APART)} as diff_chr, {_if(_APART + ' and mapq >= 5')} as diff_chr_mapq5
    from (select *, coalesce(lead(ref_id) over (partition by name order by id), -1) as next_ref_id from {_A})"""


def _pct(part: str, whole: str) -> str:
    return f"case when {whole} > 0 then cast({part} as double) / {whole} * 100.0 else 0.0 end as {part}_pct"


#: Pairs of mates in files, from rows with file_no and place.
FILE_MATES = f"""with prim as (select *, row_number() over (order by file_no, id) as pid from {{rows}} where (flag & 2304) = 0),
    isl as (select *, pid - row_number() over (partition by file_no, name order by pid) as g from prim),
    num as (select *, row_number() over (partition by file_no, name, g order by pid) - 1 as k from isl),
    pr as (select name, g, file_no, k // 2 as pk, count(*) as n, min(id) as id1, max(id) as pair_id, min(place) as place1, max(place) as place2,
      max(case when k % 2 = 0 then ref_id end) as r1, max(case when k % 2 = 0 then pos end) as p1,
      max(case when k % 2 = 1 then ref_id end) as r2, max(case when k % 2 = 1 then pos end) as p2,
      bool_and((flag & 1028) = 0 and ref_id >= 0 and pos >= 0 and mapq >= 30 and coalesce(nm <= 5, true) and coalesce(as_score >= 100, true)) as ok
      from num where name is not null group by file_no, name, g, k // 2 having count(*) = 2),
    con as (select pair_id, a.name as c1, p1, b.name as c2, p2 from pr join bam_refs a on a.ref_id = r1 join bam_refs b on b.ref_id = r2 where ok),
    half as (select pair_id, c1, p1 - p1 % {BIN} as b1, c2, p2 - p2 % {BIN} as b2 from con),
    bins as (select pair_id, case when c1 > c2 or (c1 = c2 and b1 > b2) then c2 else c1 end as chrom1, case when c1 > c2 or (c1 = c2 and b1 > b2) then b2 else b1 end as bin1,
      case when c1 > c2 or (c1 = c2 and b1 > b2) then c1 else c2 end as chrom2, case when c1 > c2 or (c1 = c2 and b1 > b2) then b1 else b2 end as bin2 from half)"""
#: The same over one file.
_MATES = FILE_MATES.format(rows=f"(select *, 0 as file_no, id as place from {_A})")

ORACLE = {
    "bam_flags": "select id, " + ", ".join(f"{c} as {n}" for n, c in _FLAG.items()) + f" from {_A}",
    "bam_flagstat": _STAT,
    "bam_flagstat_pct": f"""select *, {_pct('mapped', 'total')}, {', '.join(_pct(c, 'paired_in_seq') for c in ('properly_paired', 'mate_mapped', 'singletons', 'diff_chr', 'diff_chr_mapq5'))}
        from ({_STAT})""",
    "hic_mates": f"{_MATES} select pair_id, id1, pair_id as id2 from pr",
    "hic_pairs": f"{_MATES} select pair_id, c1 as chrom1, p1 as pos1, c2 as chrom2, p2 as pos2 from con",
    "hic_contact_matrix": f'{_MATES} select chrom1, bin1, chrom2, bin2, count(*) as "count" from bins group by 1, 2, 3, 4',
    "hic_summary": f"""{_MATES} select count(*) as total_pairs, count(*) filter (where chrom1 = chrom2) as intra_pairs, count(*) filter (where chrom1 <> chrom2) as inter_pairs,
        count(distinct (chrom1, bin1, chrom2, bin2)) as populated_bins, count(*) filter (where chrom1 = chrom2) * 100.0 / count(*)::double as intra_pct,
        count(*) filter (where chrom1 <> chrom2) * 100.0 / count(*)::double as inter_pct from bins""",
    "hic_merge_partials": 'select chrom1, bin1, chrom2, bin2, cast(sum(pair_count) as bigint) as "count" from contact_bins group by 1, 2, 3, 4',
}
