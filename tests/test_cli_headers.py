import gzip

import pytest

from strandforge import cli


@pytest.mark.parametrize(
    "raw,names,want",
    [
        (b">a one\nAC\n> b x\nGG\n", "b,a", ">b x\nGG\n>a one\nAC\n"),
        (b">a\nAC\n> a\nGG\n", "a", ">a\nGG\n"),
        (b">a\nACGT\n>d\nGG\n  >c\ty\nTT\n", "c,no,a", ">c y\nTT\n>a\nACGT\n"),
        (b">a\nAC\n >\nGG\n", "a", ">a\nAC\n"),
    ],
)
def test_few_names_by_index_and_scan(spark, tmp_path, raw, names, want):
    (tmp_path / "x.fa").write_bytes(raw)
    (tmp_path / "x.fa.gz").write_bytes(gzip.compress(raw))
    for f in ("x.fa", "x.fa.gz"):
        out = tmp_path / "o.fa"
        assert cli.main(["fa-some-records", "-f", str(tmp_path / f), "-n", names, "-o", str(out)], spark) == 0
        assert out.read_text() == want
