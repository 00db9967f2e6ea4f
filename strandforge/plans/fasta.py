"""Queries of the FASTA operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandforge.functions import seq as S
from strandforge.operators import fasta
from strandforge.plans import adapters
from strandforge.session import spread, table


def _seqs(spark, d):
    return spread(table(spark, d, "sequences"))


def _wanted(spark, d):
    return fasta.targets(adapters.wanted(spark, d))


def _region(spark, d):
    n = S.seq_length("sequence")
    return fasta.region(_seqs(spark, d).filter(n > 0), F.floor(n / 4).cast("bigint"), F.lit(100).cast("bigint"))


def _index(spark, d):
    ord_ = F.struct("indexed_at", "byte_offset", "length", "line_bases", "line_width", "description")
    return fasta.index_rows(table(spark, d, "faidx").withColumn("ord", ord_).drop("indexed_at"))


def _offsets(spark, d):
    idx = table(spark, d, "faidx").filter(F.col("length") > 0)
    return idx.select("file_name", "name", "indexed_at", S.base_offset(F.col("length") - 1, "byte_offset").alias("last_base_at"))


QUERIES = {
    "fa_length": lambda spark, d: fasta.lengths(_seqs(spark, d)),
    "fa_base_counts": lambda spark, d: _seqs(spark, d).select("id", *[c.alias(n) for n, c in S.base_counts("sequence").items()]),
    "fa_gc_pct": lambda spark, d: _seqs(spark, d).select("id", S.gc_pct("sequence").alias("gc_pct")),
    "fa_n_count": lambda spark, d: _seqs(spark, d).select("id", S.n_count("sequence").alias("n_count"), S.is_empty("sequence").alias("is_empty")),
    "fa_filter": lambda spark, d: fasta.filter_records(_seqs(spark, d), 200, 5000, 45.0).select("id", "name"),
    "fa_filter_counts": lambda spark, d: fasta.filter_counts(_seqs(spark, d), min_len=200, max_len=5000, min_gc=45.0),
    "fa_stats": lambda spark, d: fasta.stats(_seqs(spark, d), gc=True),
    "fa_nx": lambda spark, d: fasta.nx(_seqs(spark, d), {"n50": 0.5, "n75": 0.75, "n90": 0.9}),
    "fa_rename": lambda spark, d: fasta.rename(_seqs(spark, d), adapters.name_map(spark, d)).select("id", "name", "description"),
    "fa_rename_keep_old_id": lambda spark, d: fasta.rename(_seqs(spark, d), adapters.name_map(spark, d), True).select("id", "name", "description"),
    "fa_rename_counts": lambda spark, d: fasta.rename_counts(_seqs(spark, d), adapters.name_map(spark, d)),
    "fa_one_record": lambda spark, d: fasta.one_record(_seqs(spark, d), "ostsen4_00000000").select("id", "name", "sequence"),
    "fa_some_records": lambda spark, d: fasta.some_records(_seqs(spark, d), _wanted(spark, d)).select("ord", "id", "name", "sequence"),
    "fa_some_records_first": lambda spark, d: fasta.some_records(_seqs(spark, d), _wanted(spark, d), "first").select("ord", "id", "name"),
    "fa_missing_records": lambda spark, d: fasta.missing_records(_seqs(spark, d), _wanted(spark, d)),
    "fa_extraction_counts": lambda spark, d: fasta.extraction_counts(_seqs(spark, d), _wanted(spark, d)),
    "fa_region": lambda spark, d: _region(spark, d).select("id", "name", "sequence"),
    "fa_fold": lambda spark, d: _seqs(spark, d).select("id", S.fold("sequence", 80).alias("folded")),
    "fa_text": lambda spark, d: fasta.to_text(_seqs(spark, d), 60),
    "fa_text_unfolded": lambda spark, d: fasta.to_text(_seqs(spark, d), None),
    "fa_revcomp": lambda spark, d: _seqs(spark, d).select("id", S.revcomp("sequence").alias("revcomp")),
    "fa_header_parts": lambda spark, d: _seqs(spark, d).select("id", S.trim_blank("description").alias("description")),
    "fa_index": _index,
    "fa_faidx_offsets": _offsets,
    "fmt_commas": lambda spark, d: table(spark, d, "kmc_dbs").select("db_id", S.with_commas("total_kmers").alias("total_kmers")),
}

_LAST = "row_number() over (partition by name order by indexed_at desc, byte_offset desc, file_name desc) as rn"
_RENAMED = f"""from sequences s left join (select name, file_name || ':' || name as new_name, {_LAST} from faidx where name is not null) m
    on m.name = s.name and m.rn = 1"""
_WANTED = "(select trim(ref_name) as name, min(stat_id) as ord from kmer_coverage where trim(ref_name) <> '' group by 1)"
_GC = "case when strlen(sequence) = 0 then 0.0 else cast(length(sequence) - length(translate(sequence, 'GCgc', '')) as double) / strlen(sequence) * 100.0 end"
_CLASSES = ", ".join(f"count(*) filter (where strlen(sequence) >= {n}) as count_ge_{c}" for c, n in fasta.LENGTH_CLASSES.items())


def _nx(f: float) -> str:
    return f"(select cast(coalesce(max(len), 0) as bigint) from c, t where cum >= floor(cast(tot as double) * cast({f} as double)))"


_CUM = """with l as (select strlen(sequence) as len, id from sequences), t as (select sum(len) as tot from l),
    c as (select len, sum(len) over (order by len desc, id rows between unbounded preceding and current row) as cum from l)"""
_REV = f"reverse(translate(regexp_replace(sequence, '[^{S.COMPLEMENT_FROM}]', 'N', 'g'), '{S.COMPLEMENT_FROM}', '{S.COMPLEMENT_TO}'))"


def _some(order: str) -> str:
    return f"(select *, row_number() over (partition by name order by id {order}) as rn from sequences)"


def _folded(width: int) -> str:
    return f"rtrim(regexp_replace(sequence, '(.{{{width}}})', '\\1' || chr(10), 'g'), chr(10))"


_HEAD = "'>' || name || case when coalesce(description, '') <> '' then ' ' || description else '' end"

ORACLE = {
    "fa_length": "select id, name, cast(strlen(sequence) as bigint) as length from sequences",
    "fa_base_counts": "select id, " + ", ".join(f"length(sequence) - length(translate(sequence, '{b}{b.lower()}', '')) as count_{b.lower()}" for b in "ATGCN") + " from sequences",
    "fa_gc_pct": f"select id, {_GC} as gc_pct from sequences",
    "fa_n_count": "select id, length(sequence) - length(translate(sequence, 'Nn', '')) as n_count, sequence = '' as is_empty from sequences",
    "fa_filter": f"select id, name from sequences where strlen(sequence) between 200 and 5000 and {_GC} >= 45.0",
    "fa_filter_counts": f"""select count(*) as total, count(*) filter (where k) as passed, count(*) filter (where not k) as removed
        from (select strlen(sequence) between 200 and 5000 and {_GC} >= 45.0 as k from sequences)""",
    "fa_stats": f"""{_CUM} select count(*) as num_sequences, cast(sum(strlen(sequence)) as bigint) as total_length,
        cast(min(strlen(sequence)) as bigint) as min_length, cast(max(strlen(sequence)) as bigint) as max_length,
        cast(sum(strlen(sequence)) // count(*) as bigint) as avg_length,
        cast(sum(length(sequence) - length(translate(sequence, 'Nn', ''))) as bigint) as non_atgc_bases,
        cast(sum(length(sequence) - length(translate(sequence, 'Nn', ''))) as double) / sum(strlen(sequence)) * 100.0 as non_atgc_pct,
        cast(sum(length(sequence) - length(translate(sequence, 'GCgc', ''))) as double) / sum(strlen(sequence)) * 100.0 as gc_pct,
        {_nx(0.5)} as n50, {_nx(0.9)} as n90, {_CLASSES} from sequences""",
    "fa_nx": f"{_CUM} select {_nx(0.5)} as n50, {_nx(0.75)} as n75, {_nx(0.9)} as n90",
    "fa_rename": f"select s.id, coalesce(m.new_name, s.name) as name, s.description {_RENAMED}",
    "fa_rename_keep_old_id": f"""select s.id, coalesce(m.new_name, s.name) as name, case when m.new_name is null then s.description
        when coalesce(trim(s.description), '') = '' then 'old_id=' || s.name else s.description || ' old_id=' || s.name end as description {_RENAMED}""",
    "fa_rename_counts": "select count(*) as total, count(*) filter (where name in (select name from faidx where name is not null)) as renamed from sequences",
    "fa_one_record": "select id, name, sequence from sequences where name = 'ostsen4_00000000' order by id desc limit 1",
    "fa_some_records": f"select w.ord, s.id, s.name, s.sequence from {_WANTED} w join {_some('desc')} s on s.name = w.name and s.rn = 1",
    "fa_some_records_first": f"select w.ord, s.id, s.name from {_WANTED} w join {_some('asc')} s on s.name = w.name and s.rn = 1",
    "fa_missing_records": f"select w.ord, w.name from {_WANTED} w where not exists (select 1 from sequences s where s.name = w.name)",
    "fa_extraction_counts": f"select count(*) as requested, count(*) filter (where name in (select name from sequences)) as found from {_WANTED}",
    "fa_region": """select id, case when s = 0 and n <= 100 then name else name || ':' || (s + 1) || '-' || (s + least(100, n - s)) end as name,
        substr(sequence, s + 1, 100) as sequence from (select *, strlen(sequence) as n, strlen(sequence) // 4 as s from sequences where sequence <> '')""",
    "fa_fold": f"select id, {_folded(80)} as folded from sequences",
    "fa_text": f"select id, {_HEAD} || case when sequence = '' then '' else chr(10) || {_folded(60)} end as \"value\" from sequences",
    "fa_text_unfolded": f"select id, {_HEAD} || chr(10) || sequence as \"value\" from sequences",
    "fa_revcomp": f"select id, {_REV} as revcomp from sequences",
    "fa_header_parts": "select id, trim(description, ' ' || chr(9) || chr(10) || chr(12) || chr(13)) as description from sequences",
    "fa_index": """select file_name, name, length, byte_offset, line_bases, line_width, case when description = '.' then '' else description end as description
        from (select *, row_number() over (partition by file_name, name order by indexed_at desc, byte_offset desc, length desc, line_bases desc, line_width desc,
        description desc) as rn from faidx) where rn = 1""",
    "fa_faidx_offsets": """select file_name, name, indexed_at, case when line_bases > 0 then byte_offset + (length - 1) // line_bases * line_width
        + (length - 1) % line_bases end as last_base_at from faidx where length > 0""",
    "fmt_commas": "select db_id, format('{:,}', total_kmers) as total_kmers from kmc_dbs",
}
