import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandforge.llm import seen
from strandforge.llm.quotient import Builder, Cascade, QuotientFilter, distinct, expected_wrong

SCHEMA = "obs_id bigint, sample string, ref_name string, k int, data binary, arrived_at timestamp, fp string, __fp string, first string"
KNOWN = "k int, data binary, extra string"
T = dt.datetime(2026, 3, 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**12 - 1)), st.lists(st.integers(0, 2**12 - 1)))
def test_quotient_filter_holds_its_keys(a, b):
    a, b = (distinct(np.array(x, np.uint64)) for x in (a, b))
    f, g = QuotientFilter.build(a, 12), QuotientFilter.build(b, 12)
    assert f.fingerprints().tolist() == a.tolist()
    every = np.arange(2**12, dtype=np.uint64)
    assert np.flatnonzero(f.contains(every)).tolist() == a.tolist()
    both = QuotientFilter.from_bytes(f.merge(g).to_bytes())
    assert both.fingerprints().tolist() == sorted({*a.tolist(), *b.tolist()})
    assert np.flatnonzero(both.contains(every)).tolist() == both.fingerprints().tolist()


def test_filter_is_compact():
    rng = np.random.default_rng(0)
    f = QuotientFilter.build(distinct(rng.integers(0, 2**48, 100_000).astype(np.uint64)), 48)
    assert len(f.to_bytes()) < 100_000 * 6 and f.nbytes < 100_000 * 6
    with pytest.raises(ValueError):
        f.merge(QuotientFilter.build(np.zeros(0, np.uint64), 20))


def brute(rows, known):
    out = []
    for r in rows:
        if r[4] is None or r[3] is None:
            continue
        old = (r[3], r[4]) in known
        if r[5] is not None and r[0] is not None:
            old = old or any(o is not r and (o[3], o[4]) == (r[3], r[4]) and o[5] is not None and o[0] is not None and (o[5], o[0]) < (r[5], r[0]) for o in rows)
        if old:
            out.append(r[0])
    return sorted(out, key=repr)


def make(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        key = int(rng.choice([1, 1, 1, *range(2, 40)]))
        at = None if rng.random() < 0.03 else T + dt.timedelta(hours=int(rng.integers(0, 90)))
        data = None if rng.random() < 0.05 else bytes([0] * 31 + [key])
        rows.append((int(rng.permutation(n)[0]) * n + i, "s", None if rng.random() < 0.2 else f"r{key % 3}", 21 if key % 2 else None if key == 8 else 31, data, at, "x", "y", "z"))
    return rows


@pytest.mark.parametrize("p", [16, 20, 48])
def test_seen_equals_brute_force(spark, p):
    rows = make(300, p)
    known = [(21, bytes([0] * 31 + [3]), "x"), (31, bytes([0] * 31 + [3]), "x"), (None, None, "x"), (31, None, "y")]
    stream, old = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(known, KNOWN)
    got = sorted((r.obs_id for r in seen.seen_before(stream, old, p).collect()), key=repr)
    assert got == brute(rows, {k[:2] for k in known})


def test_shared_fingerprints_are_told_apart(spark):
    # 12 bits for 3,000 keys: most fingerprints are shared, and the exact check has to put it right
    rows = [(i, "s", "r", 21, i.to_bytes(32, "big"), T + dt.timedelta(seconds=i % 50), "", "", "") for i in range(3000)]
    rows += [(3000 + i, "s", "r", 21, (i * 7).to_bytes(32, "big"), T + dt.timedelta(days=2), "", "", "") for i in range(200)]
    stream, old = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], KNOWN)
    assert sorted(r.obs_id for r in seen.seen_before(stream, old, 12).collect()) == list(range(3000, 3200))
    rates = {r.p_bits: r for r in seen.error_rates(stream, old, (16, 48)).collect()}
    assert rates[16].new_keys == 3000 and rates[48].wrong == 0
    assert rates[16].derived_rate == pytest.approx(expected_wrong(3000, 0, 16) / 3000)
    assert 0.5 < rates[16].measured_rate / rates[16].derived_rate < 2


def test_empty_and_repeated(spark):
    empty, old = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(21, b"x", "")], KNOWN)
    assert seen.seen_before(empty, old).count() == 0
    rows = [(1, "s", "r", 21, b"x", T, "", "", ""), (2, "s", "r", 21, b"y", T, "", "", ""), (3, "s", None, 21, b"y", T, "", "", "")]
    stream = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.obs_id for r in seen.seen_before(stream, old).collect()) == [1, 3]
    assert [tuple(r) for r in seen.first_sightings(stream, old).collect()] == [("r", 1)]


def test_filters_merge_as_rows(spark):
    a = spark.createDataFrame([(21, i.to_bytes(4, "big")) for i in range(500)], "k int, data binary")
    b = spark.createDataFrame([(21, i.to_bytes(4, "big")) for i in range(300, 900)] + [(None, None)], "k int, data binary")
    merged = seen.merge_filters(seen.build_filters(a).unionByName(seen.build_filters(b))).collect()
    want = sorted(r[0] for r in a.union(b).filter("data is not null").select(seen.fingerprint(48).alias("f")).distinct().collect())
    assert sorted(int(x) | r.shard << 48 - seen.LEAST_BITS for r in merged for x in QuotientFilter.from_bytes(r["filter"]).fingerprints()) == want
    assert len({r.shard for r in merged}) == len(merged)


def test_blocks_in_any_cut():
    rng = np.random.default_rng(2)
    keys = distinct(np.concatenate([rng.integers(0, 2**40, 60_000), rng.integers(0, 2**22, 30_000), np.arange(2**40 - 5000, 2**40)]).astype(np.uint64))
    f = QuotientFilter.build(keys, 40)
    assert np.array_equal(f.fingerprints(), keys)
    ask = distinct(np.concatenate([keys[::7], rng.integers(0, 2**40, 5000).astype(np.uint64), np.array([0, 2**40 - 1], np.uint64)]))
    assert np.array_equal(f.contains(ask), np.isin(ask, keys))
    b = Builder(40, len(keys))
    for part in np.array_split(keys, 137):
        b.append(part)
    assert b.finish().to_bytes() == f.to_bytes()


def test_cascade_is_small_and_rewrites_little():
    """Many known keys and small days: the filters are the only state, and the large one isn't rebuilt every day."""
    rng = np.random.default_rng(1)
    known = distinct(rng.integers(0, 2**42, 400_000).astype(np.uint64))
    c = Cascade(42)
    c.absorb(QuotientFilter.build(known, 42))
    big, held = c.filters[0], set(known.tolist())
    for _ in range(60):
        day = distinct(np.concatenate([rng.integers(0, 2**42, 500).astype(np.uint64), rng.choice(known, 100)]))
        got = np.concatenate([c.fresh(day[:300]), c.fresh(day[300:])])
        assert got.tolist() == [x not in held for x in day.tolist()]
        held |= set(day.tolist())
        c.close_day()
    assert c.filters[0] is big and len(c.filters) < 10 and c.n == len(held)
    assert c.nbytes < 8 * len(held)


def test_days_before_1970_and_1900(spark):
    day = lambda y: dt.datetime(y, 1, 1)
    rows = [(1, 21, b"a", day(1890)), (2, 21, b"a", day(1899)), (3, 21, b"a", day(1969)), (4, 21, b"b", day(1890)), (5, 21, b"b", day(2020)), (6, 21, b"c", dt.datetime(1899, 12, 31)), (7, 21, b"c", dt.datetime(1899, 12, 30))]
    stream = spark.createDataFrame(rows, "obs_id bigint, k int, data binary, arrived_at timestamp")
    old = spark.createDataFrame([], "k int, data binary")
    assert sorted(r.obs_id for r in seen.seen_before(stream, old).collect()) == [2, 3, 5, 6]


def test_many_known_keys_and_a_small_batch(spark):
    known = spark.range(300_000).select(F.lit(21).alias("k"), F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("data"))
    stream = spark.range(299_950, 300_050).select(F.col("id").alias("obs_id"), F.lit(21).alias("k"), F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("data"), F.lit(T).alias("arrived_at"))
    assert sorted(r.obs_id for r in seen.seen_before(stream, known).collect()) == list(range(299_950, 300_000))
    assert [r.n_new for r in seen.new_keys_by_day(stream, known).collect()] == [50]
    assert {r.kind: r.n_keys for r in seen.stored_keys(stream, known).collect()} == {"known": 300_000, "stream": 100, "merged": 300_050}
    assert seen.shards_for(10**10) == 13
