"""KMC databases (``.kmc_pre`` and ``.kmc_suf``) as a Spark data source of (kmer, count).

The driver reads the header and cuts the table of first k-mers (LUT) into ranges of about equal numbers of k-mers; a task
reads its part of both files. Rows come in file order within a range: by bin, prefix and suffix. Exactly ``total_kmers`` rows
are given. Counts are little-endian whole numbers.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandforge import schemas
from strandforge.errors import MalformedFile
from strandforge.sources import files

VERSION = 0x200
RANGE = 4_000_000
CHUNK = 200_000


@dataclass
class Header:
    kmer_length: int
    mode: int
    counter_size: int
    lut_prefix_length: int
    signature_length: int
    min_count: int
    max_count: int
    total_kmers: int
    both_strands: bool
    version: int
    slots: int

    @property
    def suffix_length(self) -> int:
        return self.kmer_length - self.lut_prefix_length

    @property
    def record_size(self) -> int:
        return self.counter_size + -(-self.suffix_length // 4)


def read_header(prefix: str) -> Header:
    """Header of a database and the number of LUT slots."""
    path = f"{files.kmc_prefix(prefix)}.kmc_pre"
    size = files.byte_size(path)
    if size < 12:
        raise MalformedFile(f"{path}: too small for a KMC prefix file")
    with files.open_raw(path) as f:
        f.seek(size - 8)
        (length,) = struct.unpack("<I", f.read(4))
        start = size - 8 - length
        if start < 4:
            raise MalformedFile(f"{path}: bad header offset")
        f.seek(start)
        raw = f.read(length)
    if len(raw) < 68:
        raise MalformedFile(f"{path}: short header")
    k, mode, counter, lut, signature, low, high, total = struct.unpack_from("<7IQ", raw)
    (version,) = struct.unpack_from("<I", raw, 64)
    map_start = start - 4 * (4**signature + 1)
    slots = (map_start - 12) // (8 * 4**lut) * 4**lut
    if slots < 0 or k < lut:
        raise MalformedFile(f"{path}: sizes of the header don't fit the file")
    return Header(k, mode, counter, lut, signature, low, high, total, raw[36] == 0, version, slots)


def first_kmers(prefix: str, header: Header) -> np.ndarray:
    """The LUT: index of the first k-mer of each slot. A local file is mapped, another one read."""
    path = f"{files.kmc_prefix(prefix)}.kmc_pre"
    if not header.slots:
        return np.zeros(0, "<u8")
    if "://" not in path:
        return np.memmap(path, "<u8", "r", 4, (header.slots,))
    with files.open_raw(path) as f:
        f.seek(4)
        return np.frombuffer(f.read(8 * header.slots), "<u8")


@dataclass
class Range(InputPartition):
    """k-mers [lo, hi) of the database."""

    lo: int
    hi: int


class KmcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.prefix = files.kmc_prefix(options["path"])
        self.range = int(options.get("rangeKmers", RANGE))
        self.header = read_header(self.prefix)

    def partitions(self) -> list[Range]:
        cuts = [*range(0, self.header.total_kmers, self.range), self.header.total_kmers]
        return [Range(a, b) for a, b in zip(cuts, cuts[1:])] or [Range(0, 0)]

    def read(self, partition: Range):
        import pyarrow as pa

        h, first = self.header, first_kmers(self.prefix, self.header)
        letters = np.frombuffer(b"ACGT", np.uint8)
        n_suffix = -(-h.suffix_length // 4)
        with files.open_raw(f"{self.prefix}.kmc_suf") as f:
            f.seek(4 + partition.lo * h.record_size)
            for lo in range(partition.lo, partition.hi, CHUNK):
                n = min(CHUNK, partition.hi - lo)
                raw = f.read(n * h.record_size)
                if len(raw) < n * h.record_size:
                    raise MalformedFile(f"{self.prefix}.kmc_suf: fewer records than the header says")
                rows = np.frombuffer(raw, np.uint8).reshape(n, h.record_size)
                # the last slot that starts at or before a k-mer holds it
                slot = np.searchsorted(first, np.arange(lo, lo + n, dtype=np.uint64), side="right") - 1
                prefix = slot % 4**h.lut_prefix_length
                text = np.empty((n, h.kmer_length), np.uint8)
                for i in range(h.lut_prefix_length):
                    text[:, i] = letters[(prefix >> (2 * (h.lut_prefix_length - 1 - i))) & 3]
                for i in range(h.suffix_length):
                    text[:, h.lut_prefix_length + i] = letters[(rows[:, i // 4] >> (6 - 2 * (i % 4))) & 3]
                count = np.zeros(n, np.int64)
                for i in range(h.counter_size):
                    count |= rows[:, n_suffix + i].astype(np.int64) << (8 * i)
                offsets = np.arange(n + 1, dtype=np.int32) * h.kmer_length
                kmers = pa.StringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(text.tobytes()))
                yield pa.RecordBatch.from_arrays([kmers, pa.array(count)], names=["kmer", "count"])


class KmcSource(DataSource):
    """``spark.read.format("kmc").load(prefix)``."""

    @classmethod
    def name(cls) -> str:
        return "kmc"

    def schema(self) -> str:
        return schemas.KMC

    def reader(self, schema) -> KmcReader:
        return KmcReader(self.options)


def read_kmc(spark: SparkSession, prefix: str, range_kmers: int = RANGE, in_memory: bool = False) -> DataFrame:
    """(kmer, count) of a database; ``in_memory`` keeps it in the executors' storage after the first use."""
    spark.dataSource.register(KmcSource)
    df = spark.read.format("kmc").option("rangeKmers", range_kmers).load(prefix)
    return df.persist() if in_memory else df


def count_few(prefix: str, kmers: list[str]) -> list[int]:
    """J4 for few k-mers: the count of each (0 if absent), by reading only the records of its prefix in each bin.

    Letters are upper-cased; a text of another length or with other letters is absent. Beyond some thousands of k-mers
    ``operators.kmers.lookup`` reads the database once instead.
    """
    h = read_header(prefix)
    first, total, size = first_kmers(prefix, h), h.total_kmers, h.record_size
    n_suffix, per_bin, out = size - h.counter_size, 4**h.lut_prefix_length, []
    codes = {letter: i for i, letter in enumerate("ACGT")}
    with files.open_raw(f"{files.kmc_prefix(prefix)}.kmc_suf") as f:
        for kmer in kmers:
            digits = [codes.get(c, -1) for c in (kmer or "").upper()]
            if len(digits) != h.kmer_length or min(digits) < 0:
                out.append(0)
                continue
            head = 0
            for d in digits[: h.lut_prefix_length]:
                head = head * 4 + d
            tail = digits[h.lut_prefix_length :] + [0] * (-h.suffix_length % 4)
            want = np.array([a << 6 | b << 4 | c << 2 | d for a, b, c, d in zip(*[iter(tail)] * 4)], np.uint8)
            found = 0
            for slot in range(head, h.slots, per_bin):
                lo, hi = int(first[slot]), int(first[slot + 1]) if slot + 1 < h.slots else total
                if lo < hi:
                    f.seek(4 + lo * size)
                    rows = np.frombuffer(f.read((hi - lo) * size), np.uint8).reshape(-1, size)
                    for r in rows[(rows[:, :n_suffix] == want).all(axis=1)]:
                        found += int.from_bytes(r[n_suffix:].tobytes(), "little")
            out.append(found)
    return out


def header_frame(spark: SparkSession, prefix: str) -> DataFrame:
    """The header in one row."""
    h = read_header(prefix)
    values = [getattr(h, c.split()[0]) for c in schemas.KMC_HEADER.split(", ")]
    return spark.createDataFrame([tuple(values)], schemas.KMC_HEADER)
