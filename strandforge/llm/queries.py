"""The queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandforge.llm import distinct, encode, frequent, neardup, packing, percentiles, repetition, seen, spans
from strandforge.session import spread, table

KMER = ["k", "data"]


def _hexed(df):
    return df.withColumn("data_hex", F.hex("data")).drop("data")


def _bounds(one):
    # nine tenths, but for two documents, which is more than that in the smallest tables
    return one.select("cases", *[(F.col("hits") + 2 >= F.col(c) * 0.9).alias(n) for c, n in (("cases", "recalled"), ("said", "precise"))])


QUERIES = {
    "p1_found": lambda spark, d: seen.seen_before(table(spark, d, "kmer_stream"), table(spark, d, "known_kmers")),
    "p1_first_sightings": lambda spark, d: seen.first_sightings(table(spark, d, "kmer_stream"), table(spark, d, "known_kmers")),
    "p1_filters": lambda spark, d: seen.stored_keys(table(spark, d, "kmer_stream"), table(spark, d, "known_kmers")),
    "p1_new_by_day": lambda spark, d: seen.new_keys_by_day(table(spark, d, "kmer_stream"), table(spark, d, "known_kmers")),
    "p1_error_bounds": lambda spark, d: seen.error_rates(table(spark, d, "kmer_stream"), table(spark, d, "known_kmers")).select("p_bits", "new_keys", "as_derived"),
    "p1_error_rates": lambda spark, d: seen.error_rates(table(spark, d, "kmer_stream"), table(spark, d, "known_kmers")),
    "p3_found": lambda spark, d: spans.pairs(spread(table(spark, d, "sequences"))),
    "p3_shared": lambda spark, d: spans.shared(spread(table(spark, d, "sequences"))),
    "p3_members": lambda spark, d: spans.members(spread(table(spark, d, "sequences"))),
    "p3_repeats": lambda spark, d: spans.repeats(spans.matches(spread(table(spark, d, "sequences")))),
    "p4_coverage_distinct": lambda spark, d: distinct.coverage_distinct(table(spark, d, "kmer_coverage")),
    "p4_stream_distinct": lambda spark, d: distinct.stream_distinct(table(spark, d, "kmer_stream"), table(spark, d, "known_kmers")),
    "p4_error": lambda spark, d: distinct.coverage_error(table(spark, d, "kmer_coverage")),
    "p4_stream_error": lambda spark, d: distinct.stream_error(table(spark, d, "kmer_stream"), table(spark, d, "known_kmers")),
    "p5_percentiles": lambda spark, d: percentiles.percentiles(table(spark, d, "reads"), table(spark, d, "fq_summaries"), table(spark, d, "faidx")),
    "p5_rank_error": lambda spark, d: percentiles.rank_errors(table(spark, d, "reads"), table(spark, d, "fq_summaries"), table(spark, d, "faidx")),
    "p6_found": lambda spark, d: _hexed(frequent.frequent_exact(table(spark, d, "kmer_stream"), KMER).drop("n_rows")),
    "p6_intervals": lambda spark, d: _hexed(frequent.intervals(table(spark, d, "kmer_stream"), KMER)),
    "p6_frequent": lambda spark, d: _hexed(frequent.frequent(table(spark, d, "kmer_stream"), KMER)),
    "p7_found": lambda spark, d: neardup.found({t: spread(table(spark, d, t)) for t in ("reads", "sequences")}),
    "p7_groups": lambda spark, d: neardup.groups({t: spread(table(spark, d, t)) for t in ("reads", "sequences")}),
    "p8_ids": lambda spark, d: encode.encode_column(spread(table(spark, d, "documents"))),
    "p9_fill": lambda spark, d: packing.fill_documents(spread(table(spark, d, "documents"))),
    "p9_packing": lambda spark, d: packing.checked(spread(table(spark, d, "documents"))),
    "p9_usage": lambda spark, d: packing.usage(packing.fill_documents(spread(table(spark, d, "documents")))),
    "p10_found": lambda spark, d: repetition.found(spread(table(spark, d, "documents"))),
    "p10_repeated": lambda spark, d: repetition.repeated(spread(table(spark, d, "documents"))),
    "p10_fertility_recall": lambda spark, d: repetition.fertility_recall(spread(table(spark, d, "documents"))),
    "p10_fertility_bounds": lambda spark, d: _bounds(repetition.fertility_recall(spread(table(spark, d, "documents")))),
    "p10_fertility": lambda spark, d: repetition.fertility(spread(table(spark, d, "documents"))),
}

_SEEN = """
    select s.obs_id, s.ref_name, s.arrived_at, (row_number() over (partition by s.k, s.data order by s.arrived_at, s.obs_id) > 1
           or w.k is not null) as seen
    from kmer_stream s left join known_kmers w on w.k = s.k and w.data = s.data where s.data is not null"""

_WINDOWS = """
    select distinct id, upper(substr(sequence, i, 120)) as w from (select id, sequence, unnest(range(1, length(sequence) - 118)) as i from sequences)
    where regexp_full_match(substr(sequence, i, 120), '[ACGTacgt]+')"""


def _similar(name: str) -> str:
    return f"""
    select '{name}' as table_name, id_a, id_b from (
      with s as (select distinct id, upper(substr(sequence, i, 12)) as w from (select id, sequence, unnest(range(1, length(sequence) - 10)) as i from {name})
        where regexp_full_match(substr(sequence, i, 12), '[ACGTacgt]+')),
      n as (select id, count(*) as n from s group by id),
      c as (select a.id as id_a, b.id as id_b, count(*) as c from s a join s b on a.w = b.w and a.id < b.id group by all)
      select id_a, id_b from c join n x on x.id = id_a join n y on y.id = id_b where c * 5 >= (x.n + y.n - c) * 3)"""


_REPEATED = """
    with t as (select doc_id, translate(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x
      from documents where text is not null),
    p as (select doc_id, x, unnest(range(1, length(x) + 1)) as i from t),
    w as (select doc_id, i, case when i <= length(x) - 31 and row_number() over (partition by doc_id, substr(x, i, 32) order by i) > 1 then 1 else 0 end as again from p),
    r as (select doc_id, max(again) over (partition by doc_id order by i rows between 31 preceding and current row) as hit from w),
    h as (select doc_id, sum(hit) as hits from r group by doc_id),
    res as (select t.doc_id, length(x) as n, cast(coalesce(hits, 0) as bigint) as repeated from t left join h on h.doc_id = t.doc_id)"""

ORACLE = {
    "p3_found": f"with w as ({_WINDOWS}) select distinct a.id as id_a, b.id as id_b from w a join w b on a.w = b.w and a.id < b.id",
    "p3_members": "select id, min(id) over (partition by translate(sequence, 'acgt', 'ACGT')) as rep from sequences",
    "p3_shared": f"""
        with r as (select id, sequence, unnest(range(1, length(sequence) - 118)) as i from sequences),
        w as (select id, i, upper(substr(sequence, i, 120)) as w from r where regexp_full_match(substr(sequence, i, 120), '[ACGTacgt]+')),
        k as (select w from w group by w having count(distinct id) > 1),
        m as (select id, i, lag(i) over (partition by id order by i) as before from w where w in (select w from k)),
        t as (select id, sum(least(120, coalesce(i - before, 120))) as shared from m group by id)
        select s.id, cast(length(s.sequence) as bigint) as n_bases, cast(coalesce(shared, 0) as bigint) as shared_bases,
               case when s.sequence = '' then 0.0 else cast(coalesce(shared, 0) as double) / length(s.sequence) end as share
        from sequences s left join t using (id)""",
    "p7_found": f"{_similar('reads')} union all {_similar('sequences')}",
    "p7_groups": f"""
        with recursive found as ({_similar('reads')} union all {_similar('sequences')}),
        e as (select table_name as t, id_a as a, id_b as b from found union all select table_name, id_b, id_a from found),
        r(t, id, root) as (select t, a, b from e union select r.t, r.id, e.b from r join e on e.t = r.t and e.a = r.root),
        m as (select t, id, least(id, min(root)) as group_id from r group by t, id), n as (select t, a as id, count(*) as n from e group by t, a),
        every as (select 'reads' as t, id from reads union all select 'sequences', id from sequences)
        select every.t as table_name, every.id, coalesce(m.group_id, every.id) as group_id, coalesce(n.n, 0) as n_links
        from every left join m on m.t = every.t and m.id = every.id left join n on n.t = every.t and n.id = every.id""",
    "p10_found": f"{_REPEATED} select doc_id from res where n >= 100 and repeated * 10 >= n * 3",
    "p10_fertility_bounds": f"{_REPEATED} select count(*) as cases, true as recalled, true as precise from res where n >= 100 and repeated * 10 >= n * 3",
    "p10_repeated": f"{_REPEATED} select doc_id, n, repeated, cast(repeated as double) / greatest(n, 1) as share from res",
    "p1_found": f"select obs_id from ({_SEEN}) where seen",
    "p1_first_sightings": f"select ref_name, count(*) as first_n from ({_SEEN}) where not seen group by ref_name",
    "p1_filters": """
        with a as (select distinct k, data from kmer_stream where data is not null), w as (select distinct k, data from known_kmers)
        select 'known' as kind, count(*) as n_keys from w union all select 'stream', count(*) from a
        union all select 'merged', count(*) from (select * from a union select * from w)""",
    "p1_new_by_day": f"select day, count(*) as n_new from (select seen, cast(arrived_at as date) as day from ({_SEEN})) where not seen group by day",
    "p1_error_bounds": f"select unnest([28, 32, 48])::int as p_bits, count(*) as new_keys, true as as_derived from ({_SEEN}) where not seen",
    "p4_error": """
        select cast(measured_at as date) as day, sample, db_id, cast(grouping(cast(measured_at as date)) * 4 + grouping(sample) * 2 + grouping(db_id) as int) as grouping,
               count(distinct ref_name) as n_exact, true as within
        from kmer_coverage group by cube (cast(measured_at as date), sample, db_id)""",
    "p4_stream_error": """
        select cast(arrived_at as date) as day, sample, ref_name, count(distinct case when s.data is not null then (s.k, s.data) end) as exact_ref,
               count(distinct case when w.k is not null then (s.k, s.data) end) as exact_query, true as within
        from kmer_stream s left join known_kmers w on w.k = s.k and w.data = s.data group by 1, 2, 3""",
    "p5_rank_error": """
        with ph as (select 'phred' as metric, run as grp, cast(sequenced_at as date) as day, cast(sum(length(quality)) as bigint) as n from reads where quality <> '' group by 2, 3),
        av as (select 'avg_len' as metric, platform as grp, cast(summarised_at as date) as day, count(*) as n from fq_summaries where avg_len is not null and not isnan(avg_len) group by 2, 3),
        daily as (select * from ph union all select * from av)
        select metric, grp, day, 'day' as span, n, true as within from daily
        union all select metric, grp, null, 'all', cast(sum(n) as bigint), true from daily group by metric, grp
        union all select 'length', file_name, null, 'all', count(*), true from faidx where length is not null group by file_name""",
    "p6_intervals": """
        select k, hex(data) as data_hex, count(*) as n_rows, true as inside from kmer_stream where data is not null group by k, data
        having count(*) * 400 >= (select count(*) from kmer_stream)""",
    "p9_packing": """
        select count(*) as n_documents, cast(0 as bigint) as wrong_documents, cast(0 as bigint) as overfull, true as dense
        from documents where coalesce(text, '') <> ''""",
    "p6_found": """
        select k, hex(data) as data_hex from kmer_stream where data is not null group by k, data
        having count(*) * 400 >= (select count(*) from kmer_stream)""",
}
