import pytest
from test_sources import kmc_files

from strandforge import cli
from strandforge.sources import kmc


@pytest.mark.parametrize(
    "both_strands,counts,want",
    [
        # CGT and ACG are one canonical k-mer, TTT is stored in its other form only
        (False, {"ACG": 7, "CGT": 4, "TTT": 2, "GGA": 9}, ["a\t4\t1\t2\t1\t22\t22.0000\t11.0000", "b\t3\t1\t1\t1\t2\t2.0000\t2.0000", "c\t3\t1\t1\t0\t0\t0.0000\t0.0000"]),
        (True, {"ACG": 11, "AAA": 2, "TCC": 9}, ["a\t4\t1\t2\t1\t22\t22.0000\t11.0000", "b\t3\t1\t1\t1\t2\t2.0000\t2.0000", "c\t3\t1\t1\t0\t0\t0.0000\t0.0000"]),
    ],
)
def test_kmer_cov_canonical(spark, tmp_path, both_strands, counts, want):
    kmc_files(tmp_path, counts, 3, 1, 1)
    pre = tmp_path / "db.kmc_pre"
    raw = bytearray(pre.read_bytes())
    header = len(raw) - 8 - int.from_bytes(raw[-8:-4], "little")
    raw[header + 36] = not both_strands
    pre.write_bytes(raw)
    assert kmc.read_header(str(tmp_path / "db")).both_strands == both_strands
    fa = tmp_path / "x.fa"
    fa.write_bytes(b">a\nACGT\n>b\nAAA\n>c\nCTC\n")
    out = tmp_path / "cov.tsv"
    assert cli.main(["fa-kmer-cov", "-r", str(fa), "-k", str(tmp_path / "db"), "-o", str(out), "--canonical"], spark) == 0
    assert out.read_text().splitlines()[1:] == want
