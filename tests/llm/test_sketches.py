import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandforge.llm import distinct, frequent, percentiles
from strandforge.llm.percentiles import Sketch


@pytest.mark.parametrize("bits", [8, 12, 20])
def test_distinct_error_at_any_size(spark, bits):
    sizes = {0: 1, 1: 50, 2: 3000, 3: 120_000}
    df = spark.range(max(sizes.values())).withColumn("g", F.explode(F.array(*[F.lit(g) for g in sizes])))
    keep = F.lit(False)
    for g, n in sizes.items():
        keep = keep | ((F.col("g") == g) & (F.col("id") < n))
    df = df.filter(keep).withColumn("word", F.lit(1))
    s = distinct.sketch(df, {"g": F.col("g")}, ["id"], bits)
    got = {r.g: r.n for r in distinct.estimate(s, ["g"], "n", bits).collect()}
    for g, n in sizes.items():
        assert abs(got[g] - n) <= max(1, n * 4 / 2 ** (bits / 2)), (g, n, got[g])
    assert s.groupBy("g").count().agg(F.max("count")).first()[0] <= distinct.SLICES * max(1, 2**bits // 64)


def test_distinct_merge_cube_and_nulls(spark):
    d = dt.datetime(2026, 3, 1, 5)
    rows = [(d, "a", 1, "x"), (d, "a", 1, "x"), (d, "a", 2, "y"), (None, "b", 1, None), (d, None, 1, "x"), (None, None, None, "z")]
    df = spark.createDataFrame(rows, "measured_at timestamp, sample string, db_id int, ref_name string")
    got = {(str(r.day) if r.day else None, r["sample"], r.db_id, r.grouping): r.n_ref_names for r in distinct.coverage_distinct(df).collect()}
    assert got[(None, None, None, 7)] == 3
    assert got[(None, "a", None, 5)] == 2 and got[(None, "b", None, 5)] == 0 and got[(None, None, None, 5)] == 2
    assert got[("2026-03-01", "a", 1, 0)] == 1 and got[(None, "b", 1, 0)] == 0
    assert len(got) == len(distinct.coverage_distinct(df).collect())
    assert distinct.coverage_distinct(df.limit(0)).count() == 0
    groups = {"sample": F.col("sample")}
    both = distinct.merge(distinct.sketch(df.limit(2), groups, ["ref_name"]).unionByName(distinct.sketch(df, groups, ["ref_name"])), ["sample"])
    assert {r["sample"]: r.n for r in distinct.estimate(both, ["sample"], "n").collect()} == {"a": 2, "b": 0, None: 2}


def test_small_sets_are_counted(spark):
    """Sets of up to some dozens of items are exact, also where two items share a bit, and bounds hold the truth everywhere."""
    df = spark.range(200 * 40).select((F.col("id") % 200).alias("g"), (F.col("id") * 7919).alias("id")).filter(F.col("id") % 40 <= F.col("g") % 40)
    exact = {r.g: r["count"] for r in df.groupBy("g").count().collect()}
    got = distinct.estimate(distinct.sketch(df, {"g": F.col("g")}, ["id"]), ["g"], "n").collect()
    assert {r.g: r.n for r in got} == exact and all(r.n_low == r.n == r.n_high for r in got)
    big = spark.range(60_000).select((F.col("id") % 3).alias("g"), "id")
    for r in distinct.estimate(distinct.sketch(big, {"g": F.col("g")}, ["id"]), ["g"], "n").collect():
        assert r.n_low <= 20_000 <= r.n_high and r.n_low < r.n < r.n_high
    rows = distinct.sketch(big, {"g": F.col("g")}, ["id"]).count()
    assert rows < 3 * 512 * 15


def test_stream_distinct(spark):
    d = dt.datetime(2026, 3, 1)
    rows = [(d, "s", "r", 21, b"a"), (d, "s", "r", 21, b"a"), (d, "s", "r", 31, b"a"), (d, "s", None, 21, None), (None, "s", "r", 21, b"b")]
    df = spark.createDataFrame(rows, "arrived_at timestamp, sample string, ref_name string, k int, data binary")
    known = spark.createDataFrame([(21, b"a"), (21, b"a"), (None, b"q")], "k int, data binary")
    got = {(r.day is not None, r.ref_name): (r.ref_unique_n, r.query_uniq_n) for r in distinct.stream_distinct(df, known).collect()}
    assert got == {(True, "r"): (2, 1), (True, None): (0, 0), (False, "r"): (1, 0)}


def rank_error(values, x, q):
    values = np.sort(values)
    lo, hi = np.searchsorted(values, x, "left") / len(values), np.searchsorted(values, x, "right") / len(values)
    return 0 if lo <= q <= hi else min(abs(lo - q), abs(hi - q))


@pytest.mark.parametrize("kind", ["normal", "sorted", "ties", "heavy"])
def test_compactor_rank_error(kind):
    rng = np.random.default_rng(3)
    x = {"normal": rng.normal(size=400_000), "sorted": np.arange(400_000.0), "ties": rng.integers(0, 50, 400_000).astype(float), "heavy": np.exp(rng.normal(size=400_000) * 5)}[kind]
    parts = []
    for p in np.array_split(x, 23):
        s = Sketch()
        for c in np.array_split(p, 5):
            s.add(c)
        parts.append(Sketch.from_bytes(s.to_bytes()))
    total = parts[0]
    for s in parts[1:]:
        total.merge(s)
    assert total.n == len(x) and total.size < 4 * total.k
    assert sum(int(c.sum()) << i for i, (_, c) in enumerate(total.levels)) == len(x)
    for q in (0.01, 0.5, 0.9, 0.99):
        assert rank_error(x, total.quantiles([q])[0], q) < 0.01
    if kind == "ties":
        assert total.quantiles([0.5])[0] == np.sort(x)[199_999]


def test_percentile_query(spark):
    t = dt.datetime(2026, 3, 1)
    reads = [("run1", "II!", t), ("run1", "", t), ("run1", None, t), (None, "5", None), ("run2", "~", t + dt.timedelta(days=1)), ("run1", "5555", t + dt.timedelta(days=1))]
    reads = spark.createDataFrame(reads, "run string, quality string, sequenced_at timestamp").withColumn("grp", F.lit(1))
    sums = spark.createDataFrame([("p", 10.0, t), ("p", None, t), ("p", float("nan"), t), (None, 5.0, t)], "platform string, avg_len double, summarised_at timestamp")
    fai = spark.createDataFrame([("f", 7), ("f", 9), ("f", None), ("g", None)], "file_name string, length bigint")
    got = {(r.metric, r.grp, str(r.day), r.span): (r.n, r.p50, r.p90, r.p99) for r in percentiles.percentiles(reads, sums, fai).collect()}
    assert got[("phred", "run1", "2026-03-01", "day")] == (3, 40.0, 40.0, 40.0)
    assert got[("phred", "run1", "None", "all")] == (7, 20.0, 40.0, 40.0)
    assert got[("phred", None, "None", "day")] == (1, 20.0, 20.0, 20.0) and got[("phred", "run2", "None", "all")][1] == 93.0
    assert got[("avg_len", "p", "None", "all")][0] == 1 and got[("avg_len", None, "2026-03-01", "day")][1] == 5.0
    assert got[("length", "f", "None", "all")] == (2, 7.0, 9.0, 9.0) and ("length", "g", "None", "all") not in got
    assert percentiles.percentiles(reads.limit(0), sums.limit(0), fai.limit(0)).count() == 0


@pytest.mark.parametrize("width", [20, 50])
def test_lossy_counting_bounds(spark, width):
    rng = np.random.default_rng(width)
    keys = np.concatenate([rng.zipf(1.3, 20_000) % 5000, np.zeros(3000, int)])
    rng.shuffle(keys)
    rows = [(None if rng.random() < 0.02 else 21, None if rng.random() < 0.02 else int(x).to_bytes(4, "big")) for x in keys]
    df = spark.createDataFrame(rows, "k int, data binary").withColumn("count", F.lit("x")).repartition(5)
    true = {}
    for r in rows:
        if None not in r:
            true[r] = true.get(r, 0) + 1
    frequent.CHUNK = 1000
    counts, n = frequent.lossy_counts(df, ["k", "data"], width)
    assert n == len(rows)
    got = {(r.k, bytes(r.data)): (r.count_lo, r.count_hi) for r in counts.collect()}
    for key, (lo, hi) in got.items():
        assert lo <= true[key] <= hi and hi - lo <= n / width
    assert all(c <= n / width for key, c in true.items() if key not in got)
    one_in = width - 5
    exact = {(r.k, bytes(r.data)): r.n_rows for r in frequent.frequent_exact(df, ["k", "data"], one_in, width).collect()}
    assert exact == {key: c for key, c in true.items() if c * one_in >= len(rows)}


def test_frequent_edges(spark):
    empty = spark.createDataFrame([], "k int, data binary")
    assert frequent.frequent_exact(empty, ["k", "data"]).count() == 0
    only_null = spark.createDataFrame([(None, None)] * 3, "k int, data binary")
    assert frequent.frequent_exact(only_null, ["k", "data"]).count() == 0
    ties = spark.createDataFrame([(1, b"a"), (1, b"b"), (2, b"a")] * 2, "k int, data binary")
    assert frequent.frequent_exact(ties, ["k", "data"]).count() == 3
    with pytest.raises(ValueError):
        frequent.frequent(ties, ["k"], 10, 10)
