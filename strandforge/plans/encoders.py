"""Encoders of binary files, for queries that write the tables as files and read them back."""

from __future__ import annotations

import gzip
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = 5
BINS = 4


def _bam_record(name: str, flag: int, ref: int, pos: int, mapq: int, nm: int | None, score: int | None) -> bytes:
    raw = name.encode() + b"\0"
    tags = b"".join(tag + struct.pack("<i", x) for tag, x in ((b"NMi", nm), (b"ASi", score)) if x is not None)
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(raw), mapq, 0, 0, flag, 4, -1, -1, 0) + raw + b"\x12\x48" + bytes([10, 20, 30, 40]) + tags
    return struct.pack("<i", len(body)) + body


def write_bam(rows: DataFrame, refs: list[tuple[str, int]], folder: str, file: str = "file_no") -> None:
    """One BAM file for each value of ``file``, its records in the order of ``id``; every file is written by one task."""
    names = [(n.encode() + b"\0", x) for n, x in refs]
    head = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", len(names)) + b"".join(struct.pack("<i", len(n)) + n + struct.pack("<i", x) for n, x in names)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, n = None, None, 0
        for batch in batches:
            for no, *r in zip(*(batch.column(c).to_pylist() for c in (file, "name", "flag", "ref_id", "pos", "mapq", "nm", "as_score"))):
                if no != at:
                    if out is not None:
                        out.close()
                        os.replace(f"{folder}/{at:05}.tmp", f"{folder}/{at:05}.bam")
                    at, out = no, gzip.open(f"{folder}/{no:05}.tmp", "wb", compresslevel=1)
                    out.write(head)
                out.write(_bam_record(*r))
                n += 1
        if out is not None:
            out.close()
            os.replace(f"{folder}/{at:05}.tmp", f"{folder}/{at:05}.bam")
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    columns = rows.select(file, "id", "name", "flag", "ref_id", "pos", "mapq", "nm", "as_score")
    columns.repartition(file).sortWithinPartitions(file, "id").mapInArrow(write, "n bigint").agg(F.sum("n")).first()


def signature(kmer: str = "kmer") -> F.Column:
    """The smallest window of SIGNATURE letters of a k-mer, as a number."""
    return F.conv(F.translate(F.array_min(F.transform(F.sequence(F.lit(1), F.length(kmer) - (SIGNATURE - 1)), lambda i: F.substring(kmer, i, F.lit(SIGNATURE)))), "ACGT", "0123"), 4, 10).cast("int")


def write_kmc(counts: DataFrame, prefix: str, k: int, lut: int = 3, counter: int = 4) -> None:
    """A KMC database of (kmer, count): bins by signature with their map, a table of first k-mers, suffixes and counters.

    The two files are a sequence over all k-mers, so one task writes them from a sorted stream; only the table is held.
    """
    per, width = 4**lut, -(-(k - lut) // 4)
    code = np.zeros(256, np.uint8)
    code[[*b"ACGT"]] = range(4)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BINS * per, np.int64)
        total = 0
        with open(f"{prefix}.kmc_suf.tmp", "wb") as f:
            f.write(b"KMCS")
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                letters = code[np.frombuffer("".join(batch.column("kmer").to_pylist()).encode(), np.uint8)].reshape(n, k).astype(np.int64)
                head = letters[:, :lut] @ (4 ** np.arange(lut - 1, -1, -1))
                held += np.bincount(batch.column("bin").to_numpy() * per + head, minlength=len(held))
                tail = np.zeros((n, width * 4), np.uint8)
                tail[:, : k - lut] = letters[:, lut:]
                tail = tail.reshape(n, width, 4) @ np.array([64, 16, 4, 1], np.uint8)
                number = batch.column("count").to_numpy().astype("<u8").view(np.uint8).reshape(n, 8)[:, :counter]
                f.write(np.concatenate([tail.astype(np.uint8), number], axis=1).tobytes())
                total += n
            f.write(b"KMCS")
        first = np.concatenate([[0], np.cumsum(held)[:-1]]).astype("<u8")
        signatures = (np.arange(4**SIGNATURE + 1) % BINS).astype("<u4")
        header = struct.pack("<7IQ", k, 0, counter, lut, SIGNATURE, 2, 2**31, total) + b"\1" + bytes(27) + struct.pack("<I", 0x200)
        with open(f"{prefix}.kmc_pre.tmp", "wb") as f:
            f.write(b"KMCP" + first.tobytes() + bytes(8) + signatures.tobytes() + header + struct.pack("<I", len(header)) + b"KMCP")
        for end in ("suf", "pre"):
            os.replace(f"{prefix}.kmc_{end}.tmp", f"{prefix}.kmc_{end}")
        yield pa.RecordBatch.from_pydict({"n": pa.array([total], pa.int64())})

    rows = counts.select(F.pmod(signature(), F.lit(BINS)).cast("int").alias("bin"), "kmer", F.col("count").cast("bigint").alias("count"))
    rows.repartition(1).sortWithinPartitions("bin", "kmer").mapInArrow(write, "n bigint").first()
