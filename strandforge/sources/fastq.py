"""FASTQ files as a Spark data source, strictly four lines a record.

A plain file is cut into byte ranges. Which of four lines a range begins in can't be told from its text, so the line ends of all
ranges are counted first; a range then owns the records whose first line starts in it, and knows their places in the file. A gzip
file is one range. Errors: a header without ``@`` (so any blank line), an end inside a record, a quality of another length than
its sequence. The third line isn't looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandforge import schemas
from strandforge.errors import MalformedFile
from strandforge.operators import fastq as ops
from strandforge.sources import files
from strandforge.sources.fasta import BLANK, split_header

BATCH = 10_000
SPLIT_BYTES = 128 << 20


@dataclass
class Range(InputPartition):
    """Bytes [lo, hi) of ``path`` (hi -1: to the end); ``line`` line ends come before them."""

    path: str
    file_no: int
    number: int
    lo: int
    hi: int
    line: int


def ranges(path: str, split_bytes: int) -> list[Range]:
    out = []
    for k, p in enumerate(files.listed(path, files.FASTQ_EXTENSIONS)):
        size = 0 if p.lower().endswith(".gz") else files.byte_size(p)
        cuts = [*range(0, size, split_bytes), size] if size > split_bytes else [0, -1]
        out += [Range(p, k, i, a, b, 0) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return out


def count_lines(part: Range) -> int:
    with files.open_raw(part.path) as f:
        f.seek(part.lo)
        left, n = part.hi - part.lo, 0
        while left > 0 and (raw := f.read(min(left, 8 << 20))):
            n, left = n + raw.count(b"\n"), left - len(raw)
    return n


def records(part: Range) -> Iterator[tuple[int, str, str, str, str]]:
    """(place in the file, name, description, sequence, quality)."""
    path, number = part.path, part.line
    with files.open_bytes(path) as f:
        at = part.lo
        if at:
            f.seek(at - 1)
            rest = f.readline()
            at += len(rest) - 1
            number += len(rest) > 1  # a line that began before the range and ends in it
            while number % 4 and (0 <= at < part.hi):
                at += len(line := f.readline())
                number += 1
                if not line:
                    return
        if number % 4:
            return
        i = number // 4
        while not 0 <= part.hi <= at:
            head = f.readline()
            if not head:
                return
            if not head.startswith(b"@"):
                raise MalformedFile(f"{path}: record {i}: a header must start with @")
            lines = [f.readline() for _ in range(3)]
            if not all(lines):
                raise MalformedFile(f"{path}: record {i}: the file ends inside it")
            sequence, quality = lines[0].strip(BLANK), lines[2].strip(BLANK)
            if len(sequence) != len(quality):
                raise MalformedFile(f"{path}: record {i}: sequence and quality differ in length")
            yield i, *split_header(head.strip(BLANK)), sequence.decode("utf-8", "replace"), quality.decode("utf-8", "replace")
            at += len(head) + sum(map(len, lines))
            i += 1


class FastqReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split, self.what = options["path"], int(options.get("splitBytes", 0)), options.get("rows", "records")
        self.lines = {tuple(x[:2]): x[2] for x in json.loads(options.get("lines", "[]"))}

    def partitions(self) -> list[Range]:
        parts = ranges(self.path, self.split or 1 << 62)
        for p in parts:
            p.line = self.lines.get((p.file_no, p.number), 0)
        return parts

    def read(self, partition: Range):
        import pyarrow as pa

        if self.what == "counts":
            n = count_lines(partition) if partition.hi >= 0 else 0
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([partition.file_no], pa.int32()), "split": pa.array([partition.number], pa.int32()), "n": pa.array([n], pa.int64())})
            return
        kinds = [pa.int64(), *[pa.string()] * 5]
        names = ["id", "name", "description", "sequence", "quality", "file"]
        rows, first = [], partition.file_no << files.PLACE_BITS
        for i, *rest in records(partition):
            rows.append((first + i, *rest, partition.path))
            if len(rows) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


class FastqSource(DataSource):
    """``spark.read.format("fastq").load(path)``: a file, a folder or a pattern, one task a file (see read_fastq for ranges)."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "file_no int, split int, n bigint" if self.options.get("rows") == "counts" else schemas.FASTQ

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


def read_fastq(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """FASTQ records; ``id`` is the place in the file plus the file's number times 2**40.

    Plain files above ``split_bytes`` are read by ranges, after a job that counts their line ends; the driver holds one number a
    range.
    """
    spark.dataSource.register(FastqSource)
    read = spark.read.format("fastq")
    if all(r.number == 0 for r in ranges(path, split_bytes)):
        return read.load(path)
    counts = read.option("splitBytes", split_bytes).option("rows", "counts").load(path).orderBy("file_no", "split").collect()
    lines, total, file_no = [], 0, -1
    for r in counts:
        total = total if r["file_no"] == file_no else 0
        file_no = r["file_no"]
        lines.append((file_no, r["split"], total))
        total += r["n"]
    return spark.read.format("fastq").option("splitBytes", split_bytes).option("lines", json.dumps(lines)).load(path)


def read_pairs(spark: SparkSession, first: str, second: str) -> DataFrame:
    """S3: (id, r1, r2) of mates by place; of several files a side, the first goes with the first, and so on."""
    return ops.pairs(read_fastq(spark, first), read_fastq(spark, second))
