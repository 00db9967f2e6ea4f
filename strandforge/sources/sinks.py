"""Text outputs: distributed folders, and single files where a command promises one.

A single file is written by the driver from ordered rows, partition by partition, so it never holds the whole result. Numbers with
decimals are formatted here from the binary value, not in Spark, whose rounding differs.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandforge.operators import fasta, fastq
from strandforge.operators.fasta import LENGTH_CLASSES


def write_lines(lines: Iterable[str], path: str) -> int:
    """Lines to one file, gzipped if its name ends in .gz; the number of lines."""
    n = 0
    with gzip.open(path, "wt", compresslevel=1, encoding="utf-8", newline="\n") if path.lower().endswith(".gz") else open(path, "w", encoding="utf-8", newline="\n") as f:
        for line in lines:
            f.write(line)
            f.write("\n")
            n += 1
    return n


def ordered_values(df: DataFrame, *order: str) -> Iterator[str]:
    """``value`` of the rows in order, one partition at a time."""
    return (r[0] for r in df.orderBy(*order).select("value").toLocalIterator())


def write_fasta(records: DataFrame, path: str, width: int | None = 80, order: str = "id") -> int:
    """K1: records in one file; the number of records."""
    text = fasta.to_text(records.withColumn("id", F.col(order)), width)
    return write_lines(ordered_values(text, "id"), path)


def write_fastq(reads: DataFrame, path: str) -> int:
    """K2."""
    return write_lines(ordered_values(fastq.to_text(reads), "id"), path)


def write_fasta_folder(records: DataFrame, path: str, width: int | None = 80, gz: bool = False) -> None:
    """K1 at scale: a folder of FASTA parts, written by all tasks."""
    fasta.to_text(records, width).select("value").write.option("compression", "gzip" if gz else "none").text(path)


def write_tsv(df: DataFrame, path: str, order: list[str], header: bool = False, decimals: dict[str, int] | None = None) -> int:
    """K3, K7 to K9: columns by tabs in one file; ``decimals`` names the columns with fixed decimals."""
    places = decimals or {}

    def text(name: str, x: Any) -> str:
        return "" if x is None else f"{x:.{places[name]}f}" if name in places else str(x)

    rows = df.orderBy(*order) if order else df
    columns = df.columns

    def lines() -> Iterator[str]:
        if header:
            yield "\t".join(columns)
        for r in rows.toLocalIterator():
            yield "\t".join(text(c, x) for c, x in zip(columns, r))

    return write_lines(lines(), path)


def write_tsv_folder(df: DataFrame, path: str, order: list[str] | None = None, decimals: dict[str, int] | None = None, gz: bool = False) -> None:
    """K7 to K9 at scale: a folder of parts without a header, written by all tasks; with ``order`` the parts follow each other."""
    rows = df.orderBy(*order) if order else df
    columns, places = df.columns, decimals or {}
    fixed = [c for c in columns if c in places]
    if fixed:

        def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                arrays = [pa.array([None if x is None else f"{x:.{places[c]}f}" for x in b.column(c).to_pylist()], pa.string()) if c in places else b.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

        kinds = dict(df.dtypes)
        rows = rows.mapInArrow(numbers, ", ".join(f"`{c}` {'string' if c in places else kinds[c]}" for c in columns))
    text = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows.select(text.alias("value")).write.option("compression", "gzip" if gz else "none").text(path)


def write_fastq_folder(reads: DataFrame, path: str, gz: bool = False) -> None:
    """K2 at scale."""
    fastq.to_text(reads).select("value").write.option("compression", "gzip" if gz else "none").text(path)


def commas(n: int) -> str:
    """P13 for text."""
    return f"{n:,}"


def duration(seconds: float) -> str:
    """HH:MM:SS.mmm."""
    ms = int(seconds * 1000)
    return f"{ms // 3_600_000:02}:{ms // 60_000 % 60:02}:{ms // 1000 % 60:02}.{ms % 1000:03}"


def fasta_stats_rows(path: str, s: dict[str, Any]) -> list[tuple[str, str]]:
    """K4: 18 keys and values, whole numbers as they are."""
    names = ["num_sequences", "total_length", "min_length", "avg_length", "max_length", "non_atgc_bases", "non_atgc_pct", "n50", "n90"]
    rows = [("input_file", path)]
    rows += [(n, f"{s[n]:.2f}" if n == "non_atgc_pct" else str(s[n])) for n in names]
    return rows + [(f"count_ge_{c}", str(s[f"count_ge_{c}"])) for c in LENGTH_CLASSES]


def fastq_stats_rows(path: str, s: dict[str, Any]) -> list[tuple[str, str]]:
    """K5: 16 labels and values, whole numbers with commas, others with three decimals."""
    return [
        ("File name", path),
        ("Total bases", commas(s["total_bases"])),
        ("Total reads", commas(s["total_reads"])),
        ("% bases >=Q20", f"{s['pct_q20']:.3f}"),
        ("% bases >=Q30", f"{s['pct_q30']:.3f}"),
        ("Average read length", f"{s['avg_len']:.3f}"),
        ("Read length range", f"{s['min_len']} .. {s['max_len']}"),
        ("Quality range", f"{s['min_qual']} .. {s['max_qual']}"),
        ("Phred range", f"{s['min_phred']} .. {s['max_phred']}"),
        ("Offset", "33"),
        *[(b, commas(s[f"count_{b.lower()}"])) for b in "ATGCN"],
        ("percent G-C content", f"{s['gc_pct']:.3f}"),
    ]


def flagstat_rows(s: dict[str, Any]) -> list[tuple[str, str]]:
    """The alignment summary that is logged."""

    def share(part: str) -> str:
        return f"{commas(s[part])} ({s[part + '_pct']:.2f}%)"

    plain = [("Total reads", "total"), ("Primary reads", "primary"), ("Secondary alignments", "secondary"), ("Supplementary alignments", "supplementary"), ("Duplicate reads", "duplicates")]
    rows = [(label, commas(s[c])) for label, c in plain] + [("Mapped reads", share("mapped"))]
    rows += [(label, commas(s[c])) for label, c in [("Paired in sequencing", "paired_in_seq"), ("Read 1 count", "read1"), ("Read 2 count", "read2")]]
    rest = [("Properly paired", "properly_paired"), ("Both mates mapped", "mate_mapped"), ("Singletons", "singletons"), ("Mate mapped to diff chr", "diff_chr"), ("Diff chr (MAPQ >= 5)", "diff_chr_mapq5")]
    return rows + [(label, share(c)) for label, c in rest]


def matrix_rows(path: str, bin_size: int, limits: Any, s: dict[str, Any]) -> list[tuple[str, str]]:
    """The contact matrix summary that is logged."""
    return [
        ("File name", path),
        ("Bin size (bp)", commas(bin_size)),
        ("Min MAPQ threshold", str(limits.min_mapq)),
        ("Max NM threshold", str(limits.max_nm)),
        ("Min AS threshold", str(limits.min_as)),
        ("Total read pairs", commas(s["total_pairs"])),
        ("Intra-chromosomal pairs", f"{commas(s['intra_pairs'])} ({s['intra_pct']:.2f}%)"),
        ("Inter-chromosomal pairs", f"{commas(s['inter_pairs'])} ({s['inter_pct']:.2f}%)"),
        ("Populated matrix bins", commas(s["populated_bins"])),
    ]
