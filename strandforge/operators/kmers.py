"""k-mer operators: windows, counts, and coverage of records by a k-mer database.

A record's windows are taken from pieces of PIECE letters, which overlap by k - 1, so that no row ever holds all k-mers of a
long sequence. ``id`` must tell records apart, as that of the readers does over any number of files.

Counts and coverage with k up to 31 work on BIGINT codes, 2 bits a base, which numpy makes of whole Arrow batches: a third of the bytes of
short texts in every shuffle, and measured faster than windows of text in the JVM. Longer k-mers stay texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandforge.functions import seq as S


#: Letters a piece.
PIECE = 1 << 16


def pieces(records: DataFrame, k: int, size: int = PIECE) -> DataFrame:
    """(id, piece): every sequence of k letters or more in pieces of ``size`` windows."""
    # bytes, in which a place is found without counting characters; only the piece's number is generated, not an array of texts
    raw = records.select("id", F.col("sequence").cast("binary").alias("__b")).filter(F.octet_length("__b") >= k)
    last = F.floor((F.octet_length("__b") - k) / size).cast("int")
    return raw.select("id", "__b", F.explode(F.sequence(F.lit(0), last)).alias("__i")).select(
        "id", F.substring("__b", F.col("__i") * size + 1, F.lit(size + k - 1)).cast("string").alias("piece")
    )


def explode(records: DataFrame, k: int, canonical: bool = False, size: int = PIECE) -> DataFrame:
    """(id, kmer), one row a valid window. Null or short sequences give none."""
    got = pieces(records, k, size).select("id", F.explode(S.kmer_array("piece", k)).alias("kmer"))
    return got.withColumn("kmer", S.canonical("kmer")) if canonical else got


#: The longest k-mer that a BIGINT code holds.
PACKED = 31
#: Letters that are coded at once.
CHUNK = 2_000_000
_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def _coded(texts: list[str], k: int, canonical: bool) -> tuple[np.ndarray, np.ndarray]:
    """Text number and code of every valid window. Codes order like the k-mers, so the smaller of both strands is canonical."""
    raw = [t.encode() for t in texts]
    letter = _CODE[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    owner = np.repeat(np.arange(len(raw), dtype=np.int64), np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    n = max(0, len(letter) - k + 1)
    bad = np.concatenate([[0], np.cumsum(letter == 4, dtype=np.int32)])
    at = np.flatnonzero(bad[k : k + n] == bad[:n])
    base = (letter & 3).astype(np.int64)
    code, other = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(k):
        code = (code << 2) | base[i : i + n]
        if canonical:
            other |= (3 - base[i : i + n]) << (2 * i)
    return owner[at], (np.minimum(code, other) if canonical else code)[at]


def _counted(rows: DataFrame, k: int, canonical: bool, by_id: bool) -> DataFrame:
    """(id, piece) -> (id, code, n), a row a row of ``rows`` and code, or (code, n) counted over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("piece").to_pylist()
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= CHUNK):
                    size, b = size + len(texts[b]), b + 1
                owner, code = _coded(texts[a:b], k, canonical)
                order = np.lexsort((code, owner)) if by_id else np.argsort(code)
                owner, code = owner[order], code[order]
                new = code[1:] != code[:-1]
                start = np.flatnonzero(np.append(True, new | (owner[1:] != owner[:-1]) if by_id else new)) if len(code) else np.zeros(0, np.int64)
                n = np.diff(np.append(start, len(code)))
                for i in range(0, len(start), 100_000):
                    s = start[i : i + 100_000]
                    columns = [batch.column("id").take(pa.array(a + owner[s]))] if by_id else []
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(code[s]), pa.array(n[i : i + 100_000])], names=names)
                a = b

    names = ["id", "code", "n"] if by_id else ["code", "n"]
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, (f"id {kind}, " if by_id else "") + "code bigint, n bigint")


def _texts(codes: DataFrame, k: int) -> DataFrame:
    """(code, count) -> (kmer, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.frombuffer(b"ACGT", np.uint8)
        for batch in batches:
            code = batch.column("code").to_numpy()
            text = np.empty((len(code), k), np.uint8)
            for i in range(k):
                text[:, i] = letters[(code >> (2 * (k - 1 - i))) & 3]
            offsets = np.arange(len(code) + 1, dtype=np.int32) * k
            yield pa.RecordBatch.from_arrays([pa.StringArray.from_buffers(len(code), pa.py_buffer(offsets.tobytes()), pa.py_buffer(text.tobytes())), batch.column("count")], names=["kmer", "count"])

    return codes.select("code", "count").mapInArrow(run, "kmer string, count bigint")


def _entries(db: DataFrame, k: int) -> DataFrame:
    """(code, __c) of the database's k-mers; entries of another length or with other letters can meet no k-mer and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("kmer").to_pylist()
            owner, code = _coded(texts, k, False)
            yield pa.RecordBatch.from_arrays([pa.array(code), batch.column("__c").take(pa.array(owner))], names=["code", "__c"])

    rows = db.filter(F.octet_length("kmer") == k).select("kmer", F.col("count").cast("bigint").alias("__c"))
    return rows.mapInArrow(run, "code bigint, __c bigint")


def _short_and_long(records: DataFrame, k: int, size: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(id, piece): the records that are one piece as they are, and the pieces of the others."""
    n = F.octet_length("sequence")
    return records.filter((n >= k) & (n < size + k)).select("id", F.col("sequence").alias("piece")), pieces(records.filter(n >= size + k), k, size)


def counts(records: DataFrame, k: int, min_count: int = 1, canonical: bool = False, size: int = PIECE) -> DataFrame:
    """(kmer, count) over all records; counted partly before the shuffle."""
    if k > PACKED:
        got = explode(records, k, canonical, size).groupBy("kmer").agg(F.count(F.lit(1)).alias("count"))
        return got.filter(F.col("count") >= min_count) if min_count > 1 else got
    got = _counted(pieces(records, k, size), k, canonical, False).groupBy("code").agg(F.sum("n").alias("count"))
    return _texts(got.filter(F.col("count") >= min_count) if min_count > 1 else got, k)


def folded(db: DataFrame) -> DataFrame:
    """The database (kmer, count) by canonical k-mers; the counts of a k-mer and its reverse complement are added."""
    return db.groupBy(S.canonical("kmer").alias("kmer")).agg(F.sum("count").cast("bigint").alias("count"))


def coverage(records: DataFrame, db: DataFrame, k: int, canonical: bool = False, size: int = PIECE) -> DataFrame:
    """Per record its k-mers in total and distinct, and how the database (kmer, count) covers them.

    Every record has a row, also without k-mers. Repeated k-mers of a record are counted before the join, so it meets a k-mer
    once a record. The database must hold a k-mer once. With canonical the records' k-mers are made canonical here, those of the
    database must be so already (see folded).
    """
    if k > PACKED:
        per = explode(records, k, canonical, size).groupBy("id", "kmer").agg(F.count(F.lit(1)).alias("n"))
        hit = per.join(db.select("kmer", F.col("count").alias("__c")), "kmer", "left")
    else:
        # a record that is one piece is counted where it is read; only those of several pieces are counted by a shuffle
        short, long = _short_and_long(records, k, size)
        per = _counted(long, k, canonical, True).groupBy("id", "code").agg(F.sum("n").alias("n"))
        hit = _counted(short, k, canonical, True).unionByName(per).join(_entries(db, k), "code", "left")
    c = F.coalesce("__c", F.lit(0)).cast("bigint")
    got = hit.groupBy("id").agg(
        F.count(F.lit(1)).alias("ref_unique_n"),
        F.sum("n").alias("ref_total_n"),
        F.count_if(c > 0).alias("query_uniq_n"),
        F.sum(c * F.col("n")).alias("query_total_n"),
    )
    names = ["ref_unique_n", "ref_total_n", "query_uniq_n", "query_total_n"]
    all_ = records.select("id", F.col("name").alias("ref"), S.seq_length(F.coalesce("sequence", F.lit(""))).alias("ref_len")).join(got, "id", "left")
    all_ = all_.select("id", "ref", "ref_len", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names])

    def mean(over: str):
        return F.when(F.col(over) > 0, F.col("query_total_n") / F.when(F.col(over) > 0, F.col(over))).otherwise(0.0)

    return all_.select("*", mean("ref_unique_n").alias("mean_ref"), mean("ref_total_n").alias("mean_query"))


def lookup(kmers: DataFrame, db: DataFrame) -> DataFrame:
    """``kmers`` with the database's count (0 if absent) and whether it is there."""
    hit = kmers.join(db.select("kmer", F.col("count").alias("__c")), "kmer", "left")
    c = F.coalesce("__c", F.lit(0)).cast("bigint")
    return hit.select(*kmers.columns, c.alias("count"), (c > 0).alias("exists"))
