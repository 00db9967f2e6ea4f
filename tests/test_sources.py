import gzip
import struct

import numpy as np
import pytest

from strandforge import cli
from strandforge.errors import InvalidExtension, InvalidInput, MalformedFile
from strandforge.sources import bam, fasta, fastq, files, kmc, sinks

FA = b"junk\n>a one\ttwo\r\nACGT\r\n\r\nac gt\r\n> b\n\n  >c\tx y \nNNRY\n>a last\nGG\nTT\n>empty\n>z"


def _ref_parse(raw):
    out = []
    for line in raw.split(b"\n"):
        t = line.strip(b" \t\n\x0c\r")
        if t.startswith(b">"):
            h = t[1:].strip(b" \t\n\x0c\r").replace(b"\t", b" ", 1) if b"\t" in t else t[1:].strip(b" \t\n\x0c\r")
            name, _, desc = h.partition(b" ")
            out.append([name.decode(), desc.strip(b" \t\n\x0c\r").decode(), ""])
        elif out:
            out[-1][2] += t.decode()
    return [tuple(x) for x in out]


@pytest.mark.parametrize("split", [1, 3, 7, 16, 1000])
def test_fasta_ranges(spark, tmp_path, split):
    p = tmp_path / "x.fa"
    p.write_bytes(FA)
    rows = [(r.id, r.name, r.sequence) for r in fasta.read_fasta(spark, str(p), split).orderBy("id").collect()]
    assert rows == [(0, "a", "ACGTac gt"), (1, "b", ""), (2, "c", "NNRY"), (3, "a", "GGTT"), (4, "empty", ""), (5, "z", "")]
    desc = [r.description for r in fasta.read_fasta(spark, str(p), split).orderBy("id").collect()]
    assert desc == ["one\ttwo", "", "x y", "last", "", ""]


def test_fasta_gzip_members_and_extension(spark, tmp_path):
    p = tmp_path / "x.FNA.gz"
    p.write_bytes(gzip.compress(b">a\nAC\n") + gzip.compress(b"GT\n>b\n"))
    assert [(r.name, r.sequence) for r in fasta.read_fasta(spark, str(p)).collect()] == [("a", "ACGT"), ("b", "")]
    with pytest.raises(InvalidExtension):
        files.require_extension("x.txt", files.FASTA_EXTENSIONS)
    (tmp_path / "e.fa").write_bytes(b"")
    assert fasta.read_fasta(spark, str(tmp_path / "e.fa")).count() == 0


@pytest.mark.parametrize(
    "raw",
    [b"@a\nAC\n+\nII\n\n", b"a\nAC\n+\nII\n", b"@a\n", b"@a\nAC\n", b"@a\nAC\n+\n", b"@a\nAC\n+\nI\n"],
)
def test_fastq_errors(tmp_path, raw):
    p = tmp_path / "x.fq"
    p.write_bytes(raw)
    with pytest.raises(MalformedFile):
        list(fastq.records(fastq.Range(str(p), 0, 0, 0, -1, 0)))


def test_fastq_read_and_pairs(spark, tmp_path):
    a, b, c = (tmp_path / n for n in ("a.fq", "b.fastq.gz", "c.fq"))
    a.write_bytes(b"@r1 x y\nACGN\n+\nI5!?\n@r2\n\nanything\n\n")
    b.write_bytes(gzip.compress(b"@s1\nAC\n+\nII\n@s2\nG\n+\nI\n"))
    c.write_bytes(b"@s1\nAC\n+\nII\n")
    rows = fastq.read_fastq(spark, str(a)).orderBy("id").collect()
    assert [(r.name, r.description, r.sequence, r.quality) for r in rows] == [("r1", "x y", "ACGN", "I5!?"), ("r2", "", "", "")]
    got = fastq.read_pairs(spark, str(a), str(b)).orderBy("id").collect()
    assert [(r.r1.name, r.r2.name) for r in got] == [("r1", "s1"), ("r2", "s2")]
    with pytest.raises(Exception, match="unequal record counts; longer is the first"):
        fastq.read_pairs(spark, str(a), str(c)).collect()
    out = tmp_path / "o.fq"
    assert sinks.write_fastq(fastq.read_fastq(spark, str(a)), str(out)) == 2
    assert out.read_bytes() == b"@r1 x y\nACGN\n+\nI5!?\n@r2\n\n+\n\n"


def bam_record(name, flag, ref, pos, mapq, tags=b"", seq=b"", next_ref=-1):
    codes = [bam.BASES.index(chr(c)) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, 1, flag, len(seq), next_ref, -1, 0)
    body += name.encode() + b"\0" + b"\1\0\0\0" + packed + bytes([30] * len(seq)) + tags
    return struct.pack("<i", len(body)) + body


def bam_file(path, records, refs=(("c1", 1000), ("c2", 500))):
    head = b"BAM\1" + struct.pack("<i", 5) + b"@HD\t\n" + struct.pack("<i", len(refs))
    for n, size in refs:
        head += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size)
    raw = head + b"".join(records)
    path.write_bytes(b"".join(gzip.compress(raw[i : i + 100]) for i in range(0, len(raw), 100)))


def test_bam_tags_and_records(spark, tmp_path):
    kinds = b"XAAqXcc\1XCC\2Xss\1\0XSS\1\0Xii\1\0\0\0XII\1\0\0\0Xff\0\0\0\0XZZab\0XHHAB\0XBBs\2\0\0\0\1\0\2\0NMC\4ASs\x2c\1"
    p = tmp_path / "x.bam"
    recs = [
        bam_record("r1", 0x1, 0, 10, 60, kinds, b"ACGTN"),
        bam_record("r2", 0x100, 1, 20, 5, b"NMf\0\0\0\0ASc\x05"),
        bam_record("r3", 0x4, -1, -1, 0, b"NMC\1QQ?zzzzASC\2"),
    ]
    bam_file(p, recs)
    rows = bam.read_bam(spark, str(p)).orderBy("id").collect()
    assert [(r.id, r.primary_id, r.name, r.ref_id, r.pos, r.mapq, r.nm, r.as_score) for r in rows] == [
        (0, 0, "r1", 0, 10, 60, 4, 300),
        (1, None, "r2", 1, 20, 5, None, 5),
        (2, 1, "r3", -1, -1, 0, 1, None),
    ]
    assert rows[0].sequence == "ACGTN" and bytes(rows[0].quality) == bytes([30] * 5)
    assert bam.read_bam(spark, str(p), "name").filter("sequence is not null").count() == 0
    assert [tuple(r) for r in bam.read_refs(spark, str(p)).collect()] == [(0, "c1", 1000), (1, "c2", 500)]
    raw = gzip.decompress(p.read_bytes())
    p.write_bytes(gzip.compress(raw[:-3]))
    with pytest.raises(MalformedFile):
        with gzip.open(p) as f:
            bam.read_header(f)
            list(bam.records(f))
    p.write_bytes(gzip.compress(b"BAM\2"))
    with pytest.raises(MalformedFile):
        bam.read_refs(spark, str(p))


def kmc_files(folder, counts, k, lut, counter, bins=2, signature=3):
    """A database whose k-mers are spread over ``bins`` by their hash; layout only, no real signatures."""
    order = sorted(counts, key=lambda s: (sum(map(ord, s)) % bins, s))
    num = {c: i for i, c in enumerate("ACGT")}
    first, suffixes, at = [], b"", 0
    slot_of = []
    for s in order:
        prefix = 0
        for c in s[:lut]:
            prefix = prefix * 4 + num[c]
        slot_of.append((sum(map(ord, s)) % bins) * 4**lut + prefix)
        rest = s[lut:] + "A" * (-(k - lut) % 4)
        for i in range(0, len(rest), 4):
            v = 0
            for c in rest[i : i + 4]:
                v = v * 4 + num[c]
            suffixes += bytes([v])
        suffixes += counts[s].to_bytes(counter, "little")
    for slot in range(bins * 4**lut):
        first.append(int(np.searchsorted(slot_of, slot)))
    header = struct.pack("<7IQ", k, 0, counter, lut, signature, 1, 255, len(order)) + b"\0" + bytes(3 + 24) + struct.pack("<I", 0x200)
    pre = b"KMCP" + struct.pack(f"<{len(first)}Q", *first) + bytes(8) + bytes(4 * (4**signature + 1)) + header + struct.pack("<I", len(header)) + b"KMCP"
    (folder / "db.kmc_pre").write_bytes(pre)
    (folder / "db.kmc_suf").write_bytes(b"KMCS" + suffixes + b"KMCS")
    return order


@pytest.mark.parametrize("k,lut,counter", [(5, 2, 1), (11, 3, 2), (33, 4, 3), (7, 3, 4)])
def test_kmc_round_trip(spark, tmp_path, k, lut, counter):
    rng = np.random.default_rng(k)
    kmers = {"".join(rng.choice(list("CGT"), k)): int(rng.integers(1, 256**counter if counter < 4 else 2**32)) for _ in range(60)}
    order = kmc_files(tmp_path, kmers, k, lut, counter)
    rows = [tuple(r) for r in kmc.read_kmc(spark, str(tmp_path / "db"), 17).collect()]
    assert rows == [(s, kmers[s]) for s in order]
    h = kmc.header_frame(spark, str(tmp_path / "db.kmc_suf")).first()
    assert (h.kmer_length, h.lut_prefix_length, h.counter_size, h.total_kmers, h.both_strands) == (k, lut, counter, len(kmers), True)


def test_kmc_empty_and_small(spark, tmp_path):
    kmc_files(tmp_path, {}, 6, 2, 1)
    assert kmc.read_kmc(spark, str(tmp_path / "db")).count() == 0
    (tmp_path / "bad.kmc_pre").write_bytes(b"KMCP")
    with pytest.raises(MalformedFile):
        kmc.read_header(str(tmp_path / "bad"))


def test_index_and_fetch(tmp_path):
    p = tmp_path / "x.fa"
    p.write_bytes(b">a d\te\nACGT\nACG\n>b\r\nAC\r\nG\r\n>none\n>a\nTT\n")
    rows = fasta.build_index(str(p))
    assert rows == [("a", 7, 7, 4, 5, "d e"), ("b", 3, 20, 2, 4, "."), ("none", 0, 33, 0, 0, "."), ("a", 2, 36, 2, 3, ".")]
    assert cli.main(["fa-fai", "-f", str(p)]) == 0
    index = files.load_faidx(f"{p}.faidx")
    assert index["a"] == (2, 36, 2, 3, "")
    assert fasta.fetch(str(p), (7, 7, 4, 5, "d e"), "a") == ("a", "d e", "ACGTACG")
    assert fasta.fetch(str(p), (7, 7, 4, 5, "d e"), "a", 3, 3) == ("a:4-6", "d e", "TAC")
    assert fasta.fetch(str(p), index["b"], "b") == ("b", "", "ACG")
    assert fasta.fetch(str(p), index["none"], "none") == ("none:0-0", "", "")
    with pytest.raises(InvalidInput):
        fasta.fetch(str(p), index["b"], "b", 3, 1)
    (tmp_path / "bad.faidx").write_text("a\t1\t2\n")
    with pytest.raises(MalformedFile):
        files.load_faidx(str(tmp_path / "bad.faidx"))


def test_read_faidx(spark, tmp_path):
    p = tmp_path / "x.faidx"
    p.write_text('a\t7\t7\t4\t5\tq "x"\n\na\t2\t36\t2\t3\t.\n')
    rows = files.read_faidx(spark, str(p)).orderBy("ord").collect()
    assert [(r.name, r.length, r.description) for r in rows] == [("a", 7, 'q "x"'), ("a", 2, "")]
    p.write_text("a\t7\n")
    with pytest.raises(Exception, match="malformed"):
        files.read_faidx(spark, str(p)).collect()


def test_names_and_lists(tmp_path):
    assert files.with_suffix("d.x/a.fa.gz", "filtered") == "d.x/a.filtered.fa.gz"
    assert files.with_suffix("a.fa", "renamed") == "a.renamed.fa"
    assert files.inside_name("d/a.fa", "c1") == "d/a.c1.fa"
    assert files.is_compressed("a.ZST") and not files.is_compressed("a.fa")
    p = tmp_path / "n"
    p.write_text("# c\n b \n\na\nb\n")
    assert files.target_names([" a", "", "c"], str(p)) == ["a", "c", "b"]
    with pytest.raises(InvalidInput):
        files.target_names([], None)
    p.write_text("# c\na\tb\textra\nx\n\tq\na\tz \n")
    assert files.rename_pairs(str(p)) == [(1, "a", "b"), (4, "a", "z")]
    assert sinks.duration(3723.4567) == "01:02:03.456"
    assert f"{2.675:.2f}" == "2.67"


@pytest.fixture
def fa(tmp_path):
    p = tmp_path / "x.fa"
    p.write_bytes(b">a one\nACGTN\nACG\n>b\nGGGG\n>c x\tn\n\n>a again\nTT\n")
    return p


def test_cli_fasta(spark, fa, tmp_path):
    run = lambda *a: cli.main(list(a), spark)
    f = str(fa)
    assert run("fa-length", "-f", f) == 0
    assert (tmp_path / "x.fa.len").read_text() == "a\t8\nb\t4\nc\t0\na\t2\n"
    assert run("fa-stats", "-f", f) == 0
    got = dict(x.split("\t") for x in (tmp_path / "x.fa.summary.tsv").read_text().splitlines())
    assert len(got) == 18 and (got["num_sequences"], got["total_length"], got["avg_length"], got["non_atgc_pct"], got["n50"], got["n90"]) == ("4", "14", "3", "7.14", "8", "4")
    assert run("fa-filter", "-f", f, "-m", "2", "-M", "4", "-g", "50") == 0
    assert (tmp_path / "x.filtered.fa").read_text() == ">b\nGGGG\n"
    (tmp_path / "m.tsv").write_text("a\tfirst\nb\tnew\na\tA2\n")
    assert run("fa-rename", "-f", f, "-m", str(tmp_path / "m.tsv"), "--keep-old-id", "-w", "4") == 0
    assert (tmp_path / "x.renamed.fa").read_text() == ">A2 one old_id=a\nACGT\nNACG\n>new old_id=b\nGGGG\n>c x\tn\n>A2 again old_id=a\nTT\n"
    assert run("fa-one-record", "-f", f, "-n", "b") == 0
    assert (tmp_path / "x.b.fa").read_text() == ">b\nGGGG\n"
    assert run("fa-one-record", "-f", f, "-n", "nope") == 1
    assert run("fa-some-records", "-f", f, "-n", "c,nope", "a", "-w", "1") == 0
    assert (tmp_path / "x.some.fa").read_text() == ">c:0-0\n>a again\nT\nT\n"
    uneven = tmp_path / "u.fa"
    uneven.write_bytes(b">a\nAC\nACGT\nA\n>b\n\nGG\n")
    assert run("fa-some-records", "-f", str(uneven), "-n", "b", "a") == 0
    assert (tmp_path / "u.some.fa").read_text() == ">b\nGG\n>a\nACACGTA\n"
    (tmp_path / "q").write_text("\n".join(["a", "b", *(f"no{i}" for i in range(1000))]))
    assert run("fa-some-records", "-f", f, "-q", str(tmp_path / "q"), "-o", str(tmp_path / "o.fa.gz")) == 0
    assert gzip.decompress((tmp_path / "o.fa.gz").read_bytes()) == b">a one\nACGTNACG\n>b\nGGGG\n"
    assert run("fa-stats", "-f", str(tmp_path / "q")) == 1


@pytest.mark.parametrize("width", [1, 3, 8, 80, None])
def test_fasta_round_trip(spark, fa, tmp_path, width):
    df = fasta.read_fasta(spark, str(fa))
    out = tmp_path / "o.fa"
    assert sinks.write_fasta(df, str(out), width) == 4
    cols = ["id", "name", "description", "sequence"]
    assert fasta.read_fasta(spark, str(out)).select(cols).orderBy("id").collect() == df.select(cols).orderBy("id").collect()
    sinks.write_fasta_folder(df, str(tmp_path / "folder"), width)
    assert spark.read.text(str(tmp_path / "folder")).count() > 0


def test_cli_reads_kmers_hic(spark, fa, tmp_path):
    q = tmp_path / "r.fq"
    q.write_bytes(b"@a\nACGTN\n+\n!5?I4\n@b\n\n+\n\n")
    assert cli.main(["fq-stats", "-f", str(q)], spark) == 0
    got = dict(x.split("\t") for x in (tmp_path / "r.fq.summary.tsv").read_text().splitlines())
    assert len(got) == 16 and (got["Total reads"], got["% bases >=Q20"], got["% bases >=Q30"], got["Read length range"], got["Quality range"], got["Phred range"]) == ("2", "60.000", "40.000", "0 .. 5", "33 .. 73", "0 .. 40")
    kmc_files(tmp_path, {"ACG": 7, "GGG": 2, "TTT": 1}, 3, 1, 1)
    assert cli.main(["dump-kmc", "-p", str(tmp_path / "db.kmc_pre")], spark) == 0
    assert sorted((tmp_path / "db.dump.tsv").read_text().splitlines()) == ["ACG\t7", "GGG\t2", "TTT\t1"]
    out = tmp_path / "cov.tsv"
    assert cli.main(["fa-kmer-cov", "-r", str(fa), "-k", str(tmp_path / "db"), "-o", str(out)], spark) == 0
    assert out.read_text().splitlines() == [
        "ref\tref_len\tref_unique_n\tref_total_n\tquery_uniq_n\tquery_total_n\tmean_ref\tmean_query",
        "a\t8\t2\t3\t1\t14\t7.0000\t4.6667",
        "b\t4\t1\t2\t1\t4\t4.0000\t2.0000",
        "c\t0\t0\t0\t0\t0\t0.0000\t0.0000",
        "a\t2\t0\t0\t0\t0\t0.0000\t0.0000",
    ]
    p = tmp_path / "x.bam"
    good = b"NMC\1ASC\xc8"
    recs = [bam_record("p", 0x41, 1, 120, 60, good), bam_record("p", 0x141, 0, 5, 60, good), bam_record("p", 0x81, 0, 30, 60, good), bam_record("q", 0x41, 0, 30, 29, good), bam_record("q", 0x81, 0, 1, 60, good)]
    bam_file(p, recs)
    assert cli.main(["hic-contact-matrix", "-i", str(p), "-b", "50"], spark) == 0
    assert (tmp_path / "x.bam.50bp.matrix.tsv").read_text() == "chrom1\tbin1\tchrom2\tbin2\tcount\nc1\t0\tc2\t100\t1\n"
    assert cli.main(["hic-contact-matrix", "-i", str(p), "-b", "0"], spark) == 1
