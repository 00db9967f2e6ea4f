import pytest
from conftest import DATA
from oracle import compare, connect
from tokenizers import Tokenizer

from strandforge.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_equals_sql(spark, name):
    compare(spark, connect(), queries.QUERIES[name], queries.ORACLE[name])


def one(sql):
    con = connect()
    return con.execute(sql).fetchall()


def error_rates(rows):
    assert [r.p_bits for r in rows] == [28, 32, 48] and all(r.as_derived for r in rows)
    assert len({r.new_keys for r in rows}) == 1 and rows[-1].wrong == 0
    assert all(r.measured_rate == pytest.approx(r.wrong / r.new_keys) for r in rows)


def repeats(rows):
    text = {i: s.upper() for i, s in one("select id, sequence from sequences")}
    assert rows
    for r in rows:
        a, b = text[r.id_a][r.start_a :][: r.length], text[r.id_b][r.start_b :][: r.length]
        assert a == b and r.length >= 120 and not set(a) - set("ACGT") and r.id_a < r.id_b


def within(name, low, high, rows, exact):
    for r in rows:
        n = exact.pop(tuple(str(r[c]) for c in ("day", "sample", name)) + ((r.grouping,) if "grouping" in r else ()))
        assert r[low] <= n <= r[high]
    assert not exact


def coverage_distinct(rows):
    sql = """select cast(measured_at as date), sample, db_id, cast(grouping(cast(measured_at as date)) * 4 + grouping(sample) * 2 + grouping(db_id) as int), count(distinct ref_name)
        from kmer_coverage group by cube (cast(measured_at as date), sample, db_id)"""
    within("db_id", "n_ref_names_low", "n_ref_names_high", rows, {(*map(str, r[:3]), r[3]): r[4] for r in one(sql)})


def stream_distinct(rows):
    sql = "select cast(arrived_at as date), sample, ref_name, count(distinct case when data is not null then (k, data) end) from kmer_stream group by 1, 2, 3"
    within("ref_name", "ref_unique_n_low", "ref_unique_n_high", rows, {tuple(map(str, r[:3])): r[3] for r in one(sql)})


def percentiles(rows):
    n = one("select (select sum(length(quality)) from reads), (select count(avg_len) from fq_summaries), (select count(length) from faidx)")[0]
    assert tuple(sum(r.n for r in rows if r.metric == m and r.span == "all") for m in ("phred", "avg_len", "length")) == n
    assert all(r.p50 <= r.p90 <= r.p99 for r in rows)


def frequent(rows):
    total = one("select count(*) from kmer_stream")[0][0]
    exact = {(k, h): n for k, h, n in one("select k, hex(data), count(*) from kmer_stream where data is not null group by all")}
    got = {(r.k, r.data_hex): (r.count_lo, r.count_hi) for r in rows}
    assert all(lo <= exact[key] <= hi and hi - lo <= total / 4000 for key, (lo, hi) in got.items())
    assert {key for key, n in exact.items() if n * 400 >= total} <= set(got)


def ids(rows):
    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = dict(one("select doc_id, text from documents"))
    assert {r.doc_id: r.ids for r in rows} == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in texts.items()}


def fill(rows):
    held, pieces = {}, {}
    for r in rows:
        held[r.container] = held.get(r.container, 0) + r.length
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    assert max(held.values()) <= 2048 and sorted(held) == list(range(len(held)))
    for p in pieces.values():
        p.sort()
        size = sum(n for _, n in p)
        assert [s for s, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))] and len(p) == -(-size // 2048)
    assert len(pieces) == one("select count(*) from documents where coalesce(text, '') <> ''")[0][0]


def usage(rows):
    assert len(rows) == 1 and rows[0].least <= rows[0].containers <= rows[0].least * 1.02 + 1
    assert rows[0].unused == pytest.approx(1 - rows[0].tokens / (2048 * rows[0].containers))


def fertility(rows):
    assert len(rows) == one("select count(*) from documents where text is not null")[0][0]
    assert all(r.rejected for r in rows if r.repetitive or r.chars_per_token is None)
    assert 0.003 < sum(r.rejected for r in rows) / len(rows) < 0.4


def recall(rows):
    assert len(rows) == 1 and rows[0].hits <= min(rows[0].cases, rows[0].said)


CHECKS = {
    "p1_error_rates": error_rates,
    "p3_repeats": repeats,
    "p4_coverage_distinct": coverage_distinct,
    "p4_stream_distinct": stream_distinct,
    "p5_percentiles": percentiles,
    "p6_frequent": frequent,
    "p8_ids": ids,
    "p9_fill": fill,
    "p9_usage": usage,
    "p10_fertility": fertility,
    "p10_fertility_recall": recall,
}


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE])
def test_query_by_invariants(spark, name):
    CHECKS[name](queries.QUERIES[name](spark, DATA).collect())
