"""FASTA files as a Spark data source.

A plain file is cut into byte ranges; a range owns the records whose header line starts in it, so any number of tasks
read one file. A gzip file is one range. A line whose trimmed text starts with ``>`` is a header; what comes before the first is
skipped. Sequence lines are trimmed and joined, inner blanks and letter case stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandforge import schemas
from strandforge.sources import files

BLANK = b" \t\n\x0c\r"
SPLIT_BYTES = 64 << 20
BATCH = 2000
BATCH_BYTES = 16 << 20


@dataclass
class Range(InputPartition):
    """Records of ``path``, the listing's file ``file_no``, whose header starts in [lo, hi); hi -1 is the end."""

    path: str
    file_no: int
    number: int
    lo: int
    hi: int


def ranges(path: str, split_bytes: int) -> list[Range]:
    out = []
    for k, p in enumerate(files.listed(path, files.FASTA_EXTENSIONS)):
        size = 0 if p.lower().endswith(".gz") else files.byte_size(p)
        if size <= split_bytes:
            out.append(Range(p, k, 0, 0, -1))
        else:
            cuts = [*range(0, size, split_bytes), size]
            out += [Range(p, k, i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return out


def split_header(line: bytes) -> tuple[str, str]:
    """Name and description of a trimmed header line."""
    text = line[1:].strip(BLANK).decode("utf-8", "replace")
    cut = min((i for i in (text.find(" "), text.find("\t")) if i >= 0), default=-1)
    return (text, "") if cut < 0 else (text[:cut], text[cut + 1 :].strip(" \t\n\f\r"))


def records(part: Range) -> Iterator[tuple[int, str, str, str]]:
    """(offset, name, description, sequence) of a range."""
    with files.open_bytes(part.path) as f:
        at = part.lo
        if at:
            f.seek(at - 1)
            at += len(f.readline()) - 1  # the rest of a line that began before
        head, start, lines = None, 0, []
        for raw in f:
            line = raw.strip(BLANK)
            if line.startswith(b">"):
                if head is not None:
                    yield start, *split_header(head), b"".join(lines).decode("utf-8", "replace")
                    head = None
                if 0 <= part.hi <= at:
                    return
                head, start, lines = line, at, []
            elif head is not None:
                lines.append(line)
            elif 0 <= part.hi <= at:
                return
            at += len(raw)
        if head is not None:
            yield start, *split_header(head), b"".join(lines).decode("utf-8", "replace")


def count_headers(part: Range) -> int:
    """Records of a range, from its header lines alone: nothing is joined or decoded."""
    n = 0
    with files.open_bytes(part.path) as f:
        at = part.lo
        if at:
            f.seek(at - 1)
            at += len(f.readline()) - 1
        for raw in f:
            if 0 <= part.hi <= at:
                break
            n += raw.lstrip(BLANK).startswith(b">")
            at += len(raw)
    return n


class FastaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split, self.what = options["path"], int(options.get("splitBytes", SPLIT_BYTES)), options.get("rows", "records")

    def partitions(self) -> list[Range]:
        return ranges(self.path, self.split)

    def read(self, partition: Range):
        import pyarrow as pa

        if self.what == "counts":
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([partition.file_no], pa.int32()), "split": pa.array([partition.number], pa.int32()), "n": pa.array([count_headers(partition)], pa.int64())})
            return
        if self.what == "index":
            names = ["file", *(c.split()[0] for c in schemas.FAIDX.split(", "))]
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.string()]
            rows = [(partition.path, *r) for r in index_range(partition)]
            for i in range(0, len(rows), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + BATCH]), kinds)], names=names)
            return
        names = ["id", "name", "description", "sequence", "file", "offset", "split"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32()]
        rows, held, count = [], 0, partition.file_no << files.PLACE_BITS

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for offset, name, desc, sequence in records(partition):
            rows.append((count, name, desc, sequence, partition.path, offset, partition.number))
            count, held = count + 1, held + len(sequence)
            if len(rows) >= BATCH or held > BATCH_BYTES:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class FastaSource(DataSource):
    """``spark.read.format("fasta").load(path)``; within a file ``id`` counts by range (see read_fasta for the file's ordinals).

    ``option("rows", "counts")`` gives the records of each range, ``option("rows", "index")`` the index rows.
    """

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        kinds = {"counts": "file_no int, split int, n bigint", "index": "file string, " + schemas.FAIDX}
        return kinds.get(self.options.get("rows", "records"), schemas.FASTA + ", split int")

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)


def read_fasta(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """FASTA records of a file, folder or pattern; ``id`` is the place in the file plus the file's number times 2**40.

    So it is unique in the whole result, and orders it by file and place. Where a file has several ranges, a range's headers
    are counted first and added to the places after it.
    """
    spark.dataSource.register(FastaSource)
    read = spark.read.format("fasta").option("splitBytes", split_bytes)
    raw = read.load(path)
    columns = ["id", "name", "description", "sequence", "file", "offset"]
    if all(r.number == 0 for r in ranges(path, split_bytes)):
        return raw.select(*columns)
    per = read.option("rows", "counts").load(path)  # one row a range
    upto = F.sum("n").over(Window.partitionBy("file_no").orderBy("split"))
    before = per.select(F.col("file_no").alias("__f"), F.col("split").alias("__s"), (upto - F.col("n")).alias("__o"))
    got = raw.join(before, (F.shiftright("id", files.PLACE_BITS) == before["__f"]) & (raw["split"] == before["__s"]))
    return got.select((F.col("id") + F.col("__o")).alias("id"), *columns[1:])


def index_range(part: Range) -> Iterator[tuple[str, int, int, int, int, str]]:
    """Index rows of the records whose header starts in a range: name, length, offset, line_bases, line_width, description.

    Only ``>`` in the first column starts a record; every byte but the line end counts as a base; layout is that of the
    record's first line with bases. Descriptions have blanks for tabs and ``.`` for none.
    """
    row: list | None = None
    with files.open_raw(part.path) as f:
        at = part.lo
        if at:
            f.seek(at - 1)
            at += len(f.readline()) - 1
        for raw in f:
            begin, at = at, at + len(raw)
            if raw.startswith(b">"):
                if row is not None:
                    yield tuple(row)
                    row = None
                if 0 <= part.hi <= begin:
                    return
                text = raw[1:].decode("utf-8", "replace").rstrip()
                cut = next((i for i, c in enumerate(text) if c.isspace()), len(text))
                row = [text[:cut], 0, at, 0, 0, text[cut + 1 :].lstrip().replace("\t", " ") or "."]
            elif row is not None:
                bases = len(raw) - (2 if raw.endswith(b"\r\n") else raw.endswith(b"\n"))
                if bases:
                    row[1] += bases
                    if not row[3]:
                        row[3:5] = bases, len(raw)
            elif 0 <= part.hi <= begin:
                return
    if row is not None:
        yield tuple(row)


def build_index(path: str) -> list[tuple[str, int, int, int, int, str]]:
    """C2 on one machine: the index rows of a plain file in order."""
    files.require_extension(path, files.FASTA_EXTENSIONS, gz=False)
    return list(index_range(Range(path, 0, 0, 0, -1)))


def read_index(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """C2 by ranges on the cluster: (file, name, length, offset, line_bases, line_width, description) of plain files."""
    for p in files.listed(path, files.FASTA_EXTENSIONS):
        files.require_extension(p, files.FASTA_EXTENSIONS, gz=False)
    spark.dataSource.register(FastaSource)
    return spark.read.format("fasta").option("splitBytes", split_bytes).option("rows", "index").load(path)


def fetch(path: str, entry: tuple[int, int, int, int, str], name: str, start: int = 0, length: int | None = None) -> tuple[str, str, str]:
    """(name, description, sequence) of a record or a part of it, by one ranged read of an indexed file."""
    total, offset, bases, width, desc = entry
    whole = length is None
    if not whole and start >= total:
        raise files.InvalidInput(f"start {start} out of bounds for '{name}' of length {total}")
    n = total if whole else min(length, total - start)
    if n == 0:
        return f"{name}:{start}-{start}", "", ""
    first = offset + start // bases * width + start % bases
    last = start + n - 1
    end = offset + last // bases * width + last % bases + 1
    with files.open_raw(path) as f:
        f.seek(first)
        raw = f.read(end - first)
    text = raw.replace(b"\n", b"").replace(b"\r", b"").decode("utf-8", "replace")
    if len(text) != n:
        raise files.MalformedFile(f"{path}: lines of '{name}' aren't of one width, or the index is of another file")
    return (name if n == total and start == 0 else f"{name}:{start + 1}-{start + n}"), desc, text
