"""Queries of the FASTQ and k-mer operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandforge.functions import seq as S
from strandforge.operators import fastq, kmers
from strandforge.plans import adapters
from strandforge.plans.adapters import K
from strandforge.session import spread, table


def _reads(spark, d):
    return spread(table(spark, d, "reads"))


def _seqs(spark, d):
    return spread(table(spark, d, "sequences"))


def _pairs(spark, d):
    both = fastq.pairs(_reads(spark, d), fastq.revcomp(_reads(spark, d)))
    return both.select("id", F.col("r1.sequence").alias("seq1"), F.col("r2.sequence").alias("seq2"), F.col("r2.quality").alias("qual2"))


def _merged(spark, d):
    return fastq.summary(fastq.merge_stats(fastq.partial_stats(_reads(spark, d), ["run"]).drop("run")))


def _packed(spark, d):
    rows = spread(table(spark, d, "kmer_stream")).filter(F.col("data").isNotNull())
    return rows.select("obs_id", S.pack_kmer(S.unpack_kmer("data", "k")).alias("data"))


def _raw(spark, d):
    # qualities as alignments hold them: bytes without the offset
    shifted = "".join(chr(c) for c in range(0x21, 0x7F)), "".join(chr(c - 33) for c in range(0x21, 0x7F))
    q = F.translate("quality", *shifted).cast("binary")
    rows = _reads(spark, d).select("id", q.alias("q"))
    return rows.select("id", S.raw_mean_phred("q").alias("mean_phred"), S.raw_q_bases("q", 20).alias("q20_bases"), S.raw_q_bases("q", 30).alias("q30_bases"))


QUERIES = {
    "fq_stats": lambda spark, d: fastq.stats(_reads(spark, d)),
    "fq_stats_by_run": lambda spark, d: fastq.stats(_reads(spark, d), ["run"]),
    "fq_stats_merged": _merged,
    "fq_mean_quality": lambda spark, d: fastq.qualities(_reads(spark, d)).select("id", "mean_phred"),
    "fq_q_bases": lambda spark, d: fastq.qualities(_reads(spark, d)).select("id", "q20_bases", "q30_bases"),
    "bam_quality": _raw,
    "fq_revcomp": lambda spark, d: fastq.revcomp(_reads(spark, d)).select("id", "sequence", "quality"),
    "fq_pairs": _pairs,
    "fq_text": lambda spark, d: fastq.to_text(_reads(spark, d)),
    "kmers_explode": lambda spark, d: kmers.explode(_seqs(spark, d), K),
    "kmers_canonical": lambda spark, d: kmers.counts(_seqs(spark, d), K, canonical=True),
    "kmer_counts": lambda spark, d: kmers.counts(_reads(spark, d), K, 2),
    "fa_kmer_cov": lambda spark, d: kmers.coverage(_seqs(spark, d), adapters.kmer_db(spark, d), K),
    "fa_kmer_cov_canonical": lambda spark, d: kmers.coverage(_seqs(spark, d), adapters.kmer_db(spark, d, True), K, True),
    "kmer_exists": lambda spark, d: kmers.lookup(kmers.explode(_seqs(spark, d), K).select("kmer").distinct(), adapters.kmer_db(spark, d)),
    "kmer_unpack": lambda spark, d: spread(table(spark, d, "kmer_stream")).select("obs_id", S.unpack_kmer("data", "k").alias("kmer")),
    "kmer_pack": _packed,
    "kmc_layout": lambda spark, d: table(spark, d, "kmc_dbs").select(
        "db_id", (F.col("kmer_length") - F.col("lut_prefix_length")).cast("int").alias("suffix_length"), (F.col("counter_size") + F.ceil((F.col("kmer_length") - F.col("lut_prefix_length")) / 4)).cast("int").alias("record_size")
    ),
}

_CHARS = "list_transform(string_split(quality, ''), lambda c: ascii(c))"
_Q = "length(regexp_replace(quality, '[\\x00-{}]', '', 'g'))"
_COUNTS = ", ".join(f"cast(sum(length(sequence) - length(translate(sequence, '{b}{b.lower()}', ''))) as bigint) as count_{b.lower()}" for b in "ATGCN")
_GC = "cast(sum(length(sequence) - length(translate(sequence, 'GCgc', ''))) as double)"


def _fq(group: str = "") -> str:
    cols = f"{group}, " if group else ""
    low, high = f"coalesce(min(case when quality <> '' then list_min({_CHARS}) end), 33)", f"coalesce(max(case when quality <> '' then list_max({_CHARS}) end), 33)"

    def pct(x: str) -> str:
        return f"case when sum(strlen(sequence)) > 0 then {x} / sum(strlen(sequence)) * 100.0 else 0.0 end"

    return f"""select {cols}count(*) as total_reads, cast(sum(strlen(sequence)) as bigint) as total_bases, {_COUNTS},
        {pct(f"cast(sum({_Q.format('4')}) as double)")} as pct_q20, {pct(f"cast(sum({_Q.format('>')}) as double)")} as pct_q30,
        cast(sum(strlen(sequence)) as double) / count(*) as avg_len, cast(min(strlen(sequence)) as bigint) as min_len, cast(max(strlen(sequence)) as bigint) as max_len,
        cast({low} as int) as min_qual, cast({high} as int) as max_qual, cast(greatest({low} - 33, 0) as int) as min_phred, cast(greatest({high} - 33, 0) as int) as max_phred,
        {pct(_GC)} as gc_pct from reads {"group by " + group if group else ""}"""


_REV = f"reverse(translate(regexp_replace({{}}, '[^{S.COMPLEMENT_FROM}]', 'N', 'g'), '{S.COMPLEMENT_FROM}', '{S.COMPLEMENT_TO}'))"


def _kmers(name: str, canonical: bool = False) -> str:
    kmer = f"least(kmer, {_REV.format('kmer')})" if canonical else "kmer"
    return f"""(select id, {kmer} as kmer from (select id, upper(substr(sequence, i, {K})) as kmer from (select id, sequence, unnest(range(1, strlen(sequence) - {K} + 2)) as i
        from {name})) where regexp_full_match(kmer, '[ACGT]+'))"""


def _db(canonical: bool = False) -> str:
    return f"(select kmer, count(*) as c from {_kmers('reads', canonical)} group by kmer having count(*) >= 2)"


def _cov(canonical: bool = False) -> str:
    return f"""with per as (select id, kmer, count(*) as n from {_kmers('sequences', canonical)} group by id, kmer),
        got as (select id, count(*) as u, sum(n) as t, count(c) as qu, sum(coalesce(c, 0) * n) as qt from per left join {_db(canonical)} using (kmer) group by id)
        select s.id, s.name as ref, cast(strlen(s.sequence) as bigint) as ref_len, cast(coalesce(u, 0) as bigint) as ref_unique_n, cast(coalesce(t, 0) as bigint) as ref_total_n,
        cast(coalesce(qu, 0) as bigint) as query_uniq_n, cast(coalesce(qt, 0) as bigint) as query_total_n,
        case when u > 0 then cast(qt as double) / u else 0.0 end as mean_ref, case when t > 0 then cast(qt as double) / t else 0.0 end as mean_query
        from sequences s left join got using (id)"""


REVERSED, DATABASE, COVERAGE = _REV, _db(), _cov()

ORACLE = {
    "fq_stats": _fq(),
    "fq_stats_by_run": _fq("run"),
    "fq_stats_merged": _fq(),
    "fq_mean_quality": f"""select id, case when quality = '' then 0.0 else cast(list_sum(list_transform({_CHARS}, lambda c: greatest(c - 33, 0))) as double) / length(quality) end
        as mean_phred from reads""",
    "bam_quality": f"""select id, case when quality = '' then 0.0 else cast(list_sum(list_transform({_CHARS}, lambda c: greatest(c - 33, 0))) as double) / length(quality) end
        as mean_phred, {_Q.format('4')} as q20_bases, {_Q.format('>')} as q30_bases from reads""",
    "fq_q_bases": f"select id, {_Q.format('4')} as q20_bases, {_Q.format('>')} as q30_bases from reads",
    "fq_revcomp": f"select id, {_REV.format('sequence')} as sequence, reverse(quality) as quality from reads",
    "fq_pairs": f"select id, sequence as seq1, {_REV.format('sequence')} as seq2, reverse(quality) as qual2 from reads",
    "fq_text": """select id, '@' || name || case when coalesce(description, '') <> '' then ' ' || description else '' end || chr(10) || sequence || chr(10) || '+' || chr(10)
        || quality as "value" from reads""",
    "kmers_explode": f"select id, kmer from {_kmers('sequences')}",
    "kmers_canonical": f'select kmer, count(*) as "count" from {_kmers("sequences", True)} group by kmer',
    "kmer_counts": f'select kmer, count(*) as "count" from {_kmers("reads")} group by kmer having count(*) >= 2',
    "fa_kmer_cov": _cov(),
    "fa_kmer_cov_canonical": _cov(True),
    "kmer_exists": f"""select kmer, coalesce(c, 0) as "count", c is not null as "exists" from (select distinct kmer from {_kmers('sequences')}) left join {_db()} using (kmer)""",
    "kmer_unpack": """select obs_id, right(list_aggregate(list_transform(string_split(hex(data), ''), lambda x: translate(x, '0123456789ABCDEF', 'AAAACCCCGGGGTTTT')
        || translate(x, '0123456789ABCDEF', 'ACGTACGTACGTACGT')), 'string_agg', ''), k) as kmer from kmer_stream""",
    "kmer_pack": "select obs_id, data from kmer_stream where data is not null",
    "kmc_layout": "select db_id, cast(kmer_length - lut_prefix_length as int) as suffix_length, cast(counter_size + ceil((kmer_length - lut_prefix_length) / 4) as int) as record_size from kmc_dbs",
}
