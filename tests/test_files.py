"""Records of many files: identity, order, ranges, URIs."""

import struct

import pytest
from pyspark.sql import functions as F
from test_sources import bam_file, bam_record, kmc_files

from strandforge.errors import MalformedFile
from strandforge.operators import fasta as fasta_ops
from strandforge.operators import hic, kmers
from strandforge.sources import bam, fasta, fastq, files, kmc

FILE = 1 << files.PLACE_BITS


def test_coverage_of_two_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nACGTAC\n")
    (tmp_path / "b.fa").write_text(">x\nGGGGGG\n")
    records = fasta.read_fasta(spark, str(tmp_path))
    assert sorted(r.id for r in records.collect()) == [0, FILE]
    db = spark.createDataFrame([("GGG", 5)], "kmer string, count bigint")
    got = {r.id: (r.ref_unique_n, r.ref_total_n, r.query_uniq_n) for r in kmers.coverage(records, db, 3).collect()}
    assert got == {0: (4, 4, 0), FILE: (1, 4, 1)}
    wanted = fasta_ops.targets(spark.createDataFrame([(0, "\tx\f")], "ord bigint, name string"))
    assert [r.id for r in fasta_ops.some_records(records, wanted, "first").collect()] == [0]
    assert [r.id for r in fasta_ops.some_records(records, wanted).collect()] == [FILE]


def test_pairs_of_two_files_a_side(spark, tmp_path):
    for side in "12":
        for n in "ab":
            folder = tmp_path / side
            folder.mkdir(exist_ok=True)
            (folder / f"{n}.fq").write_text(f"@{n}{side}\nAC\n+\nII\n")
    got = fastq.read_pairs(spark, str(tmp_path / "1"), str(tmp_path / "2")).collect()
    assert sorted((r.r1["name"], r.r2["name"]) for r in got) == [("a1", "a2"), ("b1", "b2")]


def test_mates_of_two_files(spark, tmp_path):
    for n, names in (("1.bam", "xxyyz"), ("2.bam", "zppqq")):
        bam_file(tmp_path / n, [bam_record(c, 1, 0, 5, 60) for c in names])
    rows = bam.read_bam(spark, str(tmp_path / "*.bam"), "name")
    got = hic.mates(rows, 3, 2).select("pair_id", "m1.name").collect()
    # z ends one file and begins the next: no pair
    assert sorted(tuple(r) for r in got) == [(1, "x"), (3, "y"), (FILE + 2, "p"), (FILE + 4, "q")]
    assert rows.agg(F.max("primary_id")).first()[0] == FILE + 4


@pytest.mark.parametrize("block,wide", [(1, 1), (2, 3), (7, 2), (50, 10_000)])
def test_groups_of_blocks_change_nothing(spark, block, wide):
    names = "aabbbbcddeeeefffgghhhh" * 9
    df = spark.createDataFrame([(3 * i, c, 0, 0, 1, 60, None, None) for i, c in enumerate(names)], "id bigint, name string, flag int, ref_id int, pos bigint, mapq int, nm int, as_score int")
    want, i = [], 0
    while i + 1 < len(names):
        if names[i] == names[i + 1]:
            want.append(3 * (i + 1))
            i += 1
        i += 1
    assert sorted(r.pair_id for r in hic.mates(df, block, wide).collect()) == want


@pytest.mark.parametrize("split", [1, 5, 17, 64, 1000])
def test_fastq_ranges(spark, tmp_path, split):
    texts = [f"@r{i} d\n{'ACGT' * (i % 4)}\n@+\n{'@+I@' * (i % 4)}\n" for i in range(12)]
    (tmp_path / "a.fq").write_text("".join(texts))
    (tmp_path / "b.fq").write_text("".join(texts[:3])[:-1])
    (tmp_path / "c.fq").write_text("")
    rows = fastq.read_fastq(spark, str(tmp_path), split).orderBy("id").collect()
    assert [(r.id, r.name, len(r.sequence)) for r in rows] == [(i, f"r{i}", i % 4 * 4) for i in range(12)] + [(FILE + i, f"r{i}", i * 4) for i in range(3)]
    (tmp_path / "b.fq").write_text("".join(texts[:3]) + "\n")
    with pytest.raises(Exception, match="must start with @"):
        fastq.read_fastq(spark, str(tmp_path), split).count()


def test_fasta_ranges_of_many_files(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.fa").write_text("".join(f">{n}{i} x\n{'ACGTA' * i}\nAC\n" for i in range(7)))
    rows = fasta.read_fasta(spark, str(tmp_path), 20).orderBy("id").collect()
    assert [(r.id, r.name) for r in rows] == [(f * FILE + i, f"{n}{i}") for f, n in enumerate("ab") for i in range(7)]
    want = sorted(("a.fa", *r) for r in fasta.build_index(str(tmp_path / "a.fa")))
    for split in (3, 20, 10_000):
        got = [tuple(r) for r in fasta.read_index(spark, str(tmp_path), split).collect()]
        assert sorted(("a.fa", *r[1:]) for r in got if r[0].endswith("a.fa")) == want


def test_uris(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nACGTAC\n>y\nAC\n")
    uri = f"file://{tmp_path}"
    assert files.listed(uri, files.FASTA_EXTENSIONS) == [f"{uri}/a.fa"]
    assert [r.name for r in fasta.read_fasta(spark, f"{uri}/*.fa", 4).orderBy("id").collect()] == ["x", "y"]
    bam_file(tmp_path / "a.bam", [bam_record("q", 0, 0, 5, 60)])
    assert bam.read_bam(spark, f"{uri}/a.bam").first()["name"] == "q" and bam.read_refs(spark, f"{uri}/a.bam").count() == 2
    kmc_files(tmp_path, {"ACGTACG": 3, "ACGTTTT": 1}, 7, 3, 1)
    prefix = tmp_path / "db"
    assert {r.kmer: r["count"] for r in kmc.read_kmc(spark, f"file://{prefix}").collect()} == {"ACGTACG": 3, "ACGTTTT": 1}
    for p in (prefix, f"file://{prefix}"):
        assert kmc.count_few(str(p), ["acgtacg", "ACGTTTT", "AAAAAAA", "ACG", "NCGTACG", "", None]) == [3, 1, 0, 0, 0, 0, 0]
    for missing in (tmp_path / "no.fa", f"{uri}/no.fa", f"{uri}/no*.fa"):
        with pytest.raises(FileNotFoundError):
            files.listed(str(missing), files.FASTA_EXTENSIONS)


@pytest.mark.parametrize("size", [1, 4, 7, 64])
def test_pieces_give_every_window_once(spark, size):
    text = "ACGTNACGGTACCATGCANNACGTACGTTGA"
    df = spark.createDataFrame([(1, text), (2, "ACG"), (3, None), (4, ""), (5, "AC")], "id bigint, sequence string")
    want = sorted((i, t[j : j + 3]) for i, t in ((1, text), (2, "ACG")) for j in range(len(t) - 2) if "N" not in t[j : j + 3])
    assert sorted(tuple(r) for r in kmers.explode(df, 3, size=size).collect()) == want


def test_errors_name_the_record(tmp_path):
    p = tmp_path / "x.bam"
    bam_file(p, [bam_record("q", 0, 0, 5, 60)])
    with pytest.raises(MalformedFile):
        import gzip

        with gzip.open(p, "rb") as f:
            bam.read_header(f)
            raw = f.read()
        import io

        list(bam.records(io.BytesIO(struct.pack("<i", 1000) + raw[4:])))


def test_tables_as_folders(spark, tmp_path):
    from strandforge.sources import sinks

    df = spark.createDataFrame([("b", 0.00005, None), ("a", 2.5, 1)], "name string, mean double, n int")
    sinks.write_tsv_folder(df, str(tmp_path / "x"), ["name"], {"mean": 4})
    assert [r.value for r in spark.read.text(str(tmp_path / "x")).orderBy("value").collect()] == ["a\t2.5000\t1", f"b\t{0.00005:.4f}\t"]
    kmc_files(tmp_path, {"ACGTACG": 3, "ACGTTTT": 1}, 7, 3, 1)
    from strandforge import cli

    assert cli.main(["dump-kmc", "-p", str(tmp_path / "db"), "-o", str(tmp_path / "dump"), "--parts"], spark) == 0
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "dump")).collect()) == ["ACGTACG\t3", "ACGTTTT\t1"]


@pytest.mark.parametrize("k", [1, 5, 31, 32])
def test_codes_and_texts_give_the_same(spark, k):
    text = "ACGTNACGGTACCATGCANNACGTACGTTGACCATTGACGATACCATTTACGACCAGGACTTACCGATTTACCA"
    df = spark.createDataFrame([(1, "x", text), (2, "y", text.lower() * 2), (3, "z", None)], "id bigint, name string, sequence string")
    want = {}
    for i, t in ((1, text), (2, text * 2)):
        for j in range(len(t) - k + 1):
            if "N" not in t[j : j + k]:
                want.setdefault(t[j : j + k], []).append(i)
    for size in (1 << 16, 40):
        assert {r.kmer: r["count"] for r in kmers.counts(df, k, size=size).collect()} == {w: len(x) for w, x in want.items()}
    # database entries of another length or with other letters meet nothing
    db = spark.createDataFrame([*[(w, 2) for w in want], ("A" * (k + 1), 9), ("C" + "A" * k, 9), ("N" * k, 9)], "kmer string, count bigint")
    for size in (1 << 16, 40, 100):
        got = {r.id: (r.ref_unique_n, r.query_uniq_n, r.query_total_n) for r in kmers.coverage(df, db, k, size=size).collect()}
        for i in (1, 2):
            own = [x.count(i) for x in want.values() if i in x]
            assert got[i] == (len(own), len(own), 2 * sum(own))
        assert got[3] == (0, 0, 0)
    folded = {r.kmer: r["count"] for r in kmers.counts(df, k, canonical=True).collect()}
    comp = str.maketrans("ACGT", "TGCA")
    both = {}
    for w, x in want.items():
        c = min(w, w.translate(comp)[::-1])
        both[c] = both.get(c, 0) + len(x)
    assert folded == both
