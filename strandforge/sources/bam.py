"""BAM files as a Spark data source, one task a file.

``id`` is the record's place in the file and ``primary_id`` its place among primary records (null for others), each plus the
file's number times 2**40, so that they are unique and ordered over many files. CIGARs are skipped; of
the tags NM and AS are kept where they are whole numbers. ``option("columns", "name,flag")`` leaves the sequence and quality
undecoded unless they are named.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandforge import schemas
from strandforge.errors import MalformedFile
from strandforge.sources import files

# The letters of 4-bit bases, and the tag types with their sizes or formats.
BASES = "=ACMGRSVTWYHKDBN"
WHOLE = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
SIZES = {"A": 1, "f": 4}
ARRAY_SIZES = {"c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}

BATCH = 10_000
_PAIR = [BASES[i >> 4] + BASES[i & 15] for i in range(256)]
_CORE = struct.Struct("<iiBBHHHiiii")


def _need(f: BinaryIO, n: int, what: str) -> bytes:
    raw = f.read(n)
    if len(raw) < n:
        raise MalformedFile(f"BAM: the file ends in {what}")
    return raw


def read_header(f: BinaryIO) -> tuple[str, list[tuple[str, int]]]:
    """Header text and the reference dictionary."""
    if f.read(4) != b"BAM\x01":
        raise MalformedFile("not a BAM file")
    (size,) = struct.unpack("<i", _need(f, 4, "its header"))
    text = _need(f, size, "its header").decode("utf-8", "replace")
    (n,) = struct.unpack("<i", _need(f, 4, "its dictionary"))
    refs = []
    for _ in range(n):
        (size,) = struct.unpack("<i", _need(f, 4, "its dictionary"))
        name = _need(f, size, "its dictionary").rstrip(b"\0").decode("utf-8", "replace")
        refs.append((name, struct.unpack("<i", _need(f, 4, "its dictionary"))[0]))
    return text, refs


def whole_tags(raw: bytes) -> dict[str, int]:
    """Tags with whole numbers; reading stops at an unknown type."""
    out, at = {}, 0
    while at + 3 <= len(raw):
        tag, kind = raw[at : at + 2].decode("latin-1"), chr(raw[at + 2])
        at += 3
        if kind in WHOLE:
            s = struct.Struct(WHOLE[kind])
            if at + s.size > len(raw):
                break
            out[tag] = s.unpack_from(raw, at)[0]
            at += s.size
        elif kind in SIZES:
            at += SIZES[kind]
        elif kind in "ZH":
            end = raw.find(b"\0", at)
            if end < 0:
                break
            at = end + 1
        elif kind == "B" and at + 5 <= len(raw) and chr(raw[at]) in ARRAY_SIZES:
            at += 5 + ARRAY_SIZES[chr(raw[at])] * struct.unpack_from("<I", raw, at + 1)[0]
        else:
            break
    return out


def records(f: BinaryIO, want_seq: bool = True, want_qual: bool = True) -> Iterator[tuple]:
    """Records after the header, in the order of the schema without ``file``. A short size field ends the file."""
    primary = count = 0
    while len(size := f.read(4)) == 4:
        raw = _need(f, struct.unpack("<i", size)[0], f"record {count}")
        ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, next_ref, next_pos, tlen = _CORE.unpack_from(raw)
        at = _CORE.size
        name = raw[at : at + l_name].rstrip(b"\0").decode("utf-8", "replace")
        at += l_name + 4 * n_cigar
        half = (l_seq + 1) // 2
        if at + half + l_seq > len(raw):
            raise MalformedFile(f"BAM: record {count} is shorter than its parts")
        seq = "".join([_PAIR[b] for b in raw[at : at + half]])[:l_seq] if want_seq else None
        at += half
        qual = raw[at : at + l_seq] if want_qual else None
        tags = whole_tags(raw[at + l_seq :])
        is_primary = not flag & 0x900
        yield count, primary if is_primary else None, name, flag, ref, pos, mapq, next_ref, next_pos, tlen, seq, qual, tags.get("NM"), tags.get("AS")
        primary += is_primary
        count += 1


@dataclass
class File(InputPartition):
    path: str
    file_no: int


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        named = {c.strip() for c in options.get("columns", "sequence,quality").split(",")}
        self.seq, self.qual = "sequence" in named, "quality" in named

    def partitions(self) -> list[File]:
        return [File(p, k) for k, p in enumerate(files.listed(self.path, None))]

    def read(self, partition: File):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int32()] * 7, pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.string()]
        names = [c.split()[0] for c in schemas.BAM.split(", ")]
        first = partition.file_no << files.PLACE_BITS
        with files.open_raw(partition.path) as raw, gzip.GzipFile(fileobj=raw) as f:
            read_header(f)
            rows = []
            for i, primary, *rest in records(f, self.seq, self.qual):
                rows.append((first + i, None if primary is None else first + primary, *rest, partition.path))
                if len(rows) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


class BamSource(DataSource):
    """``spark.read.format("bam").option("columns", "name,flag").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return schemas.BAM

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def read_bam(spark: SparkSession, path: str, columns: str = "sequence,quality") -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("columns", columns).load(path)


def read_refs(spark: SparkSession, path: str) -> DataFrame:
    """The reference dictionary of a file, or of the first of several: (ref_id, name, length)."""
    with files.open_raw(files.listed(path, None)[0]) as raw, gzip.GzipFile(fileobj=raw) as f:
        _, refs = read_header(f)
    return spark.createDataFrame([(i, n, x) for i, (n, x) in enumerate(refs)], schemas.BAM_REFS)
