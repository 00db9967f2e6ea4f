import random

import pytest
from pyspark.sql import functions as F

from strandforge.functions import seq as S
from strandforge.operators import fasta, fastq, flagstat, hic, kmers, skew
from strandforge.streaming import stats as streaming

RECORD = "id bigint, name string, description string, sequence string, extra string"


def values(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_revcomp_and_canonical(spark):
    rng = random.Random(1)
    texts = ["", "ACGTN", "acgtn", "UuRYKMBVDHSWN", "A-C*Z", *("".join(rng.choice("ACGTNacgtnURY?") for _ in range(rng.randint(0, 40))) for _ in range(100))]
    comp = dict(zip(S.COMPLEMENT_FROM, S.COMPLEMENT_TO))
    df = spark.createDataFrame([(t,) for t in texts], "s string").coalesce(1)
    assert values(df, S.revcomp("s")) == ["".join(comp.get(c, "N") for c in reversed(t)) for t in texts]
    dna = spark.createDataFrame([("ACCGNT",), ("acgtn",)], "s string").coalesce(1)
    assert values(dna, S.revcomp(S.revcomp("s"))) == ["ACCGNT", "acgtn"]
    assert values(spark.createDataFrame([("ttt",), ("AAC",), (None,)], "s string").coalesce(1), S.canonical("s")) == ["AAA", "AAC", None]


@pytest.mark.parametrize("width", [1, 4, 7])
def test_fold(spark, width):
    texts = ["", "A", "ACGT", "ACGTACG", "ACGTACGA", "A" * 28]
    df = spark.createDataFrame([(t,) for t in texts], "s string").coalesce(1)
    assert values(df, S.fold("s", width)) == ["\n".join(t[i : i + width] for i in range(0, len(t), width)) for t in texts]


def test_qualities(spark):
    qs = ["", "!", "4567", ">?@", "~!I"]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(qs)], "id bigint, quality string")
    rows = {r.id: r for r in fastq.qualities(df).collect()}
    for i, q in enumerate(qs):
        p = [ord(c) - 33 for c in q]
        assert rows[i].mean_phred == pytest.approx(sum(p) / len(p) if p else 0.0)
        assert (rows[i].q20_bases, rows[i].q30_bases) == (sum(x >= 20 for x in p), sum(x >= 30 for x in p))


def test_kmers_edges(spark):
    seqs = [("A",), ("ACG",), ("acgnACGT",), ("",), (None,), ("NNNN",), ("A" * 50,)]
    df = spark.createDataFrame(seqs, "s string").coalesce(1)
    for k in (1, 3, 33):
        want = []
        for (s,) in seqs:
            u = (s or "").upper()
            want.append(None if s is None else [u[i : i + k] for i in range(len(u) - k + 1) if set(u[i : i + k]) <= set("ACGT")])
        assert values(df, S.kmer_array("s", k)) == want
    with pytest.raises(ValueError):
        S.kmer_array("s", 0)
    packed = spark.createDataFrame([("ACGT",), ("T" * 128,), ("A" * 129,), ("ANA",), ("",), (None,)], "s string").coalesce(1)
    got = values(packed, S.pack_kmer("s"))
    assert [None if x is None else int.from_bytes(x, "big") for x in got] == [0b00011011, 4**128 - 1, None, None, None, None]


def test_statistics_of_nothing(spark):
    empty = spark.createDataFrame([], RECORD)
    s = fasta.stats(empty, gc=True).first()
    assert set(s.asDict().values()) == {0}
    q = fastq.stats(spark.createDataFrame([], "id bigint, sequence string, quality string")).first()
    assert (q.total_reads, q.min_len, q.max_len, q.min_qual, q.max_qual, q.min_phred, q.pct_q20, q.gc_pct) == (0, 0, 0, 33, 33, 0, 0.0, 0.0)
    f = flagstat.percentages(flagstat.flagstat(spark.createDataFrame([], "flag int, ref_id int, next_ref_id int, mapq int"))).first()
    assert set(f.asDict().values()) == {0}


def test_fasta_nulls_ties_and_lookups(spark):
    rows = [(0, "a", None, "AC", "x"), (1, "a", " ", "GGGG", "y"), (2, None, "d", None, "z"), (3, "b", "q", "", "x")]
    df = spark.createDataFrame(rows, RECORD)
    s = fasta.stats(df).first()
    assert (s.num_sequences, s.total_length, s.avg_length, s.min_length, s.n50, s.n90) == (4, 6, 1, 0, 4, 2)
    names = spark.createDataFrame([(1, "a", "z"), (2, "a", "w"), (3, None, "q")], "ord bigint, old_name string, new_name string")
    got = {r.id: (r.name, r.description, r.extra) for r in fasta.rename(df, names, True).collect()}
    assert got == {0: ("w", "old_id=a", "x"), 1: ("w", "old_id=a", "y"), 2: (None, "d", "z"), 3: ("b", "q", "x")}
    clash = df.withColumns({"old_name": F.lit("o"), "new_name": F.lit("n"), "ord": F.lit(7)})
    assert {r.id: (r.name, r.old_name, r.ord) for r in fasta.rename(clash, names).collect()}[0] == ("w", "o", 7)
    wanted = fasta.targets(spark.createDataFrame([(0, "b"), (1, "no"), (2, " a "), (3, "a"), (4, None), (5, " ")], "ord bigint, name string"))
    assert [(r.ord, r.id) for r in fasta.some_records(df, wanted).orderBy("ord").collect()] == [(0, 3), (2, 1)]
    assert [(r.ord, r.id) for r in fasta.some_records(clash, wanted).orderBy("ord").collect()] == [(0, 3), (2, 1)]
    assert [(r.ord, r.id) for r in fasta.some_records(df, wanted, "first").orderBy("ord").collect()] == [(0, 3), (2, 0)]
    assert [tuple(r) for r in fasta.missing_records(df, wanted).collect()] == [(1, "no")]
    assert fasta.one_record(df, "a", "first").first().id == 0 and fasta.one_record(df, "nope").count() == 0
    r = fasta.region(df.filter("id = 1"), F.lit(1), F.lit(9)).first()
    assert (r.name, r.sequence) == ("a:2-4", "GGG")
    with pytest.raises(Exception, match="out of bounds"):
        fasta.region(df.filter("id = 1"), F.lit(4), F.lit(1)).collect()


def test_read_statistics_merge(spark):
    df = spark.createDataFrame([(0, "ACGTN", "!5?I4"), (1, "", ""), (2, None, None), (3, "gg", "~~")], "id bigint, sequence string, quality string")
    one = fastq.stats(df).first()
    parts = [fastq.partial_stats(df.filter(f"id % 2 = {i}")) for i in (0, 1)]
    assert fastq.summary(fastq.merge_stats(parts[0].unionByName(parts[1]))).first() == one
    assert (one.total_reads, one.total_bases, one.min_qual, one.max_qual, one.count_g) == (4, 7, 33, 126, 3)


def test_coverage(spark):
    rec = spark.createDataFrame([(0, "x", "ACGACGN"), (1, "y", ""), (2, "z", None)], "id bigint, name string, sequence string")
    db = spark.createDataFrame([("ACG", 5), ("TTT", 9)], "kmer string, count bigint")
    rows = {r.id: r for r in kmers.coverage(rec, db, 3).collect()}
    r = rows[0]
    assert (r.ref_len, r.ref_unique_n, r.ref_total_n, r.query_uniq_n, r.query_total_n, r.mean_ref, r.mean_query) == (7, 3, 4, 1, 10, 10 / 3, 2.5)
    assert (rows[1].ref_total_n, rows[2].mean_ref) == (0, 0.0)


ALN = "id bigint, name string, flag int, ref_id int, pos int, mapq int, nm int, as_score int"


def literal_mates(rows):
    pending, out = None, []
    for r in sorted(rows):
        if r[2] & 0x900:
            continue
        if pending is not None and r[1] is not None and pending[1] == r[1]:
            out.append((pending[0], r[0]))
            pending = None
        else:
            pending = r
    return sorted(out)


@pytest.mark.parametrize("seed,block", [(1, 1), (2, 7), (3, 50), (4, 10_000)])
def test_mates_equal_state_machine(spark, seed, block):
    rng = random.Random(seed)
    rows, i = [], 0
    while len(rows) < 400:
        name = rng.choice(["a", "b", "c", None])
        for _ in range(rng.randint(1, 5)):
            i += rng.choice([1, 1, 1, 60])
            rows.append((i, name, rng.choice([0, 0, 0, 0x100, 0x800, 0x400, 4]), 0, 1, 60, 0, 200))
    df = spark.createDataFrame(rows, ALN)
    got = sorted((r.m1.id, r.m2.id) for r in hic.mates(df, block).collect())
    assert got == literal_mates(rows)


def test_contacts_filters_and_matrix(spark):
    ok = (0, 0, 100, 60, 5, 100)
    pairs = [
        (ok, ok),
        ((0, 1, 250, 60, None, None), ok),
        ((0x400, *ok[1:]), ok),
        ((4, *ok[1:]), ok),
        ((0, 0, 100, 29, 5, 100), ok),
        ((0, 0, 100, 30, 6, 100), ok),
        ((0, 0, 100, 30, 5, 99), ok),
        ((0, 0, -1, 60, 5, 100), ok),
        ((0, 9, 100, 60, 5, 100), ok),
    ]
    rows = [(2 * i + j, f"p{i}", *m) for i, p in enumerate(pairs) for j, m in enumerate(p)]
    refs = spark.createDataFrame([(0, "c1", 1000), (1, "c0", 1000)], "ref_id int, name string, length int")
    found = hic.contacts(spark.createDataFrame(rows, ALN), refs, block=3)
    assert sorted(r.pair_id for r in found.collect()) == [1, 3]
    bins = hic.binned(found, 100)
    assert sorted(tuple(r) for r in hic.matrix(bins).collect()) == [("c0", 200, "c1", 100, 1), ("c1", 100, "c1", 100, 1)]
    assert tuple(hic.summary(bins).first()) == (2, 1, 1, 2, 50.0, 50.0)
    none = hic.summary(hic.binned(hic.contacts(spark.createDataFrame([], ALN), refs), 100)).first()
    assert tuple(none) == (0, 0, 0, 0, 0.0, 0.0)
    with pytest.raises(ValueError):
        S.bin_start("pos", 0)


def test_flagstat_literal(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(4096), rng.randint(-1, 3), rng.randint(-1, 3), rng.randint(0, 60)) for _ in range(2000)]
    got = flagstat.flagstat(spark.createDataFrame(rows, "flag int, ref_id int, next_ref_id int, mapq int")).first().asDict()
    want = dict.fromkeys(got, 0)
    for f, r, n, q in rows:
        primary, mapped = not f & 0x900, not f & 4
        want["total"] += 1
        want["secondary" if f & 0x100 else "supplementary" if f & 0x800 else "primary"] += 1
        want["duplicates"] += bool(f & 0x400)
        want["primary_duplicates"] += bool(f & 0x400) and primary
        want["mapped"] += mapped
        want["primary_mapped"] += mapped and primary
        if f & 1:
            want["paired_in_seq"] += 1
            want["read1"] += bool(f & 0x40)
            want["read2"] += bool(f & 0x80)
            want["properly_paired"] += bool(f & 2) and mapped
            want["singletons"] += mapped and bool(f & 8)
            if mapped and not f & 8:
                want["mate_mapped"] += 1
                apart = r >= 0 and n >= 0 and r != n
                want["diff_chr"] += apart
                want["diff_chr_mapq5"] += apart and q >= 5
    assert got == want


def test_salted_aggregate(spark):
    rng = random.Random(2)
    rows = [(None if (k := rng.choice([0] * 30 + [None] * 5 + list(range(1, 40)))) is None else f"k{k}", rng.choice([None, *range(9)]), "z") for _ in range(3000)]
    df = spark.createDataFrame(rows, "key string, v int, n_rows string").repartition(5)
    aggs = {"n": ("count", None), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "m": ("mean", "v")}
    got = {r.key: r for r in skew.salted_aggregate(df, ["key"], aggs, one_in=20, salts=8).collect()}
    plain = {r.key: r for r in df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("m")).collect()}
    assert got.keys() == plain.keys()
    for k, r in got.items():
        p = plain[k]
        assert (r.n, r.s, r.lo, r.hi) == (p.n, p.s, p.lo, p.hi) and r.m == pytest.approx(p.m)
        assert r.is_heavy == (r.n * 20 >= 3000)
    assert skew.salted_aggregate(df.limit(0), ["key"], aggs).count() == 0
    bins = spark.createDataFrame([("c", 0, 1), ("c", 0, None), (None, 0, 5), (None, None, 7)], "chrom1 string, bin1 bigint, pair_count bigint")
    assert [tuple(r) for r in skew.bin_totals(bins).collect()] == [("c", 0, 2, 1, True)]


def test_streaming_statistics(spark, tmp_path):
    rows = [(i, "ACGT"[: i % 5], "IIII"[: i % 5]) for i in range(20)]
    df = spark.createDataFrame(rows, "id bigint, sequence string, quality string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.start(streaming.running_stats(stream), "reads_so_far", checkpoint=str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert fastq.summary(spark.table("reads_so_far")).first() == fastq.stats(df).first()
