"""Queries that write the tables as files and read them back through the data sources, and their SQL.

The files go to the session's shared folder, which the sources open as local paths.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import functions as F

from strandforge.operators import fasta, fastq, hic, kmers
from strandforge.plans import adapters, encoders
from strandforge.plans.alignments import BIN, FILE_MATES
from strandforge.plans.reads import COVERAGE, DATABASE, REVERSED
from strandforge.session import shared_dir, table
from strandforge.sources import bam, files, kmc, sinks
from strandforge.sources import fasta as fasta_source
from strandforge.sources.fastq import read_fastq


#: Files that a table is written to.
FILES = 4


def _folder(spark, name: str) -> tuple[str, str]:
    """A new folder as Spark's path and as a local one."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    return path, urlparse(path).path


def _numbered(df):
    """Rows with the number of the file that they are written to, by ranges of ids."""
    most = df.agg(F.max("id")).first()[0] or 0
    return df.withColumn("file_no", F.floor(F.col("id") * FILES / F.lit(most + 1)).cast("int"))


def _parts(df, path: str, extension: str) -> None:
    """Text rows as FILES files, each in the order of ``id``."""
    _numbered(df).repartition("file_no").sortWithinPartitions("file_no", "id").select("value", "file_no").write.partitionBy("file_no").text(path)
    local = urlparse(path).path
    for folder in sorted(os.listdir(local)):
        for p in os.listdir(f"{local}/{folder}") if folder.startswith("file_no=") else []:
            if p.startswith("part-"):
                os.rename(f"{local}/{folder}/{p}", f"{local}/{folder[8:]}.{extension}")


def _read_fasta(spark, d):
    path, local = _folder(spark, "fasta")
    _parts(fasta.to_text(table(spark, d, "sequences"), 60), path, "fa")
    return fasta_source.read_fasta(spark, local, 1 << 20)


def _read_fastq(spark, d, change=lambda df: df):
    path, local = _folder(spark, "fastq")
    _parts(fastq.to_text(change(table(spark, d, "reads"))), path, "fq")
    return read_fastq(spark, local, 1 << 20)


def _fastq_pairs(spark, d):
    both = fastq.pairs(_read_fastq(spark, d), _read_fastq(spark, d, fastq.revcomp))
    return both.select("r1.name", F.col("r1.sequence").alias("seq1"), F.col("r2.sequence").alias("seq2"), F.col("r2.quality").alias("qual2"))


def _faidx(spark, d):
    path, _ = _folder(spark, "faidx")
    text = F.concat_ws("\t", "name", "length", "byte_offset", "line_bases", "line_width", F.coalesce(F.translate("description", "\t", " "), F.lit(".")))
    table(spark, d, "faidx").filter(F.col("name").isNotNull()).select(text.alias("value")).write.text(path)
    return files.read_faidx(spark, path).drop("ord")


def _index(spark, d):
    path, local = _folder(spark, "index")
    _parts(fasta.to_text(table(spark, d, "sequences"), 60), path, "fa")
    return fasta_source.read_index(spark, local, 1 << 20).drop("file", "offset")


def _bam_folder(spark, d) -> str:
    rows = _numbered(hic.one_delivery(table(spark, d, "alignments")))
    _, local = _folder(spark, "bam")
    os.makedirs(local)
    refs = table(spark, d, "bam_refs").orderBy("ref_id").collect()  # the dictionary, a fixed table
    encoders.write_bam(rows, [(r["name"], r["length"]) for r in refs], local)
    return f"{local}/*.bam"


def _file_and_place(c: str, names: tuple[str, str]):
    return [F.shiftright(c, files.PLACE_BITS).cast("int").alias(names[0]), F.col(c).bitwiseAND((1 << files.PLACE_BITS) - 1).alias(names[1])]


def _bam(spark, d):
    rows = bam.read_bam(spark, _bam_folder(spark, d), "name")
    return rows.select(*_file_and_place("id", ("file_no", "place")), F.col("primary_id").bitwiseAND((1 << files.PLACE_BITS) - 1).alias("primary_place"), "name", "flag", "ref_id", "pos", "mapq", "nm", "as_score")


def _bam_mates(spark, d):
    got = hic.mates(bam.read_bam(spark, _bam_folder(spark, d), "name"))
    return got.select(*_file_and_place("pair_id", ("file_no", "place2")), F.col("m1.id").bitwiseAND((1 << files.PLACE_BITS) - 1).alias("place1"), "m1.name")


def _bam_refs(spark, d):
    return bam.read_refs(spark, _bam_folder(spark, d))


def _kmc_prefix(spark, d) -> str:
    _, local = _folder(spark, "kmc")
    os.makedirs(local)
    encoders.write_kmc(adapters.kmer_db(spark, d), f"{local}/db", adapters.K)
    return f"{local}/db"


def _kmc(spark, d):
    return kmc.read_kmc(spark, _kmc_prefix(spark, d), 50_000)


def _kmc_text(spark, d):
    """The dump as a folder of text parts, read back line by line."""
    path, _ = _folder(spark, "dump")
    sinks.write_tsv_folder(_kmc(spark, d), path)
    return spark.read.text(path)


def _kmc_header(spark, d):
    return kmc.header_frame(spark, _kmc_prefix(spark, d)).select("kmer_length", "counter_size", "lut_prefix_length", "total_kmers", "both_strands")


def _kmc_few(spark, d):
    """The count of every record's first k letters, looked up one by one in the database's files."""
    prefix = _kmc_prefix(spark, d)
    asked = table(spark, d, "sequences").select("id", F.upper(F.substring("sequence", 1, adapters.K)).alias("kmer"))

    def look(batches):
        for batch in batches:
            found = kmc.count_few(prefix, batch.column("kmer").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=["id", "kmer", "count"])

    return asked.mapInArrow(look, "id bigint, kmer string, count bigint")


def _file_coverage(spark, d):
    """Coverage of FASTA files by a KMC database, both read back."""
    got = kmers.coverage(_read_fasta(spark, d), kmc.read_kmc(spark, _kmc_prefix(spark, d)), adapters.K)
    return got.drop("id")


def _matrix_text(spark, d):
    path, _ = _folder(spark, "matrix")
    found = hic.contacts(bam.read_bam(spark, _bam_folder(spark, d), "name"), table(spark, d, "bam_refs"))
    sinks.write_tsv_folder(hic.matrix(hic.binned(found, BIN)), path, ["chrom1", "bin1", "chrom2", "bin2"])
    return spark.read.text(path)


QUERIES = {
    "io_fasta": lambda spark, d: _read_fasta(spark, d).select(*_file_and_place("id", ("file_no", "place")), "name", "description", "sequence"),
    "io_fastq": lambda spark, d: _read_fastq(spark, d).select(*_file_and_place("id", ("file_no", "place")), "name", "description", "sequence", "quality"),
    "io_fastq_pairs": _fastq_pairs,
    "io_faidx": _faidx,
    "io_index": _index,
    "io_bam": _bam,
    "io_bam_refs": _bam_refs,
    "io_bam_mates": _bam_mates,
    "io_bam_matrix": _matrix_text,
    "io_kmc": _kmc,
    "io_kmc_dump": _kmc_text,
    "io_kmc_header": _kmc_header,
    "io_kmc_few": _kmc_few,
    "io_kmer_cov": _file_coverage,
}

_TRIM = "trim(coalesce(description, ''), ' ' || chr(9) || chr(10) || chr(12) || chr(13))"



def _place(name: str) -> str:
    no = f"floor(id * {FILES} / ((select max(id) from {name}) + 1))"
    return f"cast({no} as int) as file_no, row_number() over (partition by {no} order by id) - 1 as place"


_BAM = f"""(select *, row_number() over (partition by file_no order by id) - 1 as place from (select *,
    cast(floor(id * {FILES} / ((select max(id) from alignments) + 1)) as int) as file_no from (select distinct id, name, flag, ref_id, pos, mapq, nm, as_score from alignments)))"""
_SPLIT = FILE_MATES.format(rows=_BAM)

ORACLE = {
    "io_fasta": f"select {_place('sequences')}, name, {_TRIM} as description, sequence from sequences",
    "io_fastq": f"select {_place('reads')}, name, {_TRIM} as description, sequence, quality from reads",
    "io_fastq_pairs": f"select name, sequence as seq1, {REVERSED.format('sequence')} as seq2, reverse(quality) as qual2 from reads",
    "io_faidx": """select name, length, byte_offset as "offset", line_bases, line_width,
        case when coalesce(description, '.') = '.' then '' else replace(description, chr(9), ' ') end as description from faidx where name is not null""",
    "io_index": """select name, strlen(sequence) as length, least(60, strlen(sequence)) as line_bases, case when sequence = '' then 0 else least(60, strlen(sequence)) + 1 end as line_width,
        case when trim(coalesce(description, '')) = '' then '.' else replace(trim(description), chr(9), ' ') end as description from sequences""",
    "io_bam": f"""select file_no, place, case when (flag & 2304) = 0 then sum(case when (flag & 2304) = 0 then 1 else 0 end) over (partition by file_no order by place) - 1 end::bigint as primary_place,
        name, flag, ref_id, cast(pos as int) as pos, mapq, nm, as_score from {_BAM}""",
    "io_bam_refs": "select ref_id, name, length from bam_refs",
    "io_bam_mates": f"{_SPLIT} select file_no, place1, place2, name from pr",
    "io_bam_matrix": f"""{_SPLIT} select chrom1 || chr(9) || bin1 || chr(9) || chrom2 || chr(9) || bin2 || chr(9) || count(*) as "value" from bins group by chrom1, bin1, chrom2, bin2""",
    "io_kmc": f'select kmer, c as "count" from {DATABASE}',
    "io_kmc_dump": f"""select kmer || chr(9) || c as "value" from {DATABASE}""",
    "io_kmc_header": f"select {adapters.K}::bigint as kmer_length, 4::bigint as counter_size, 3::bigint as lut_prefix_length, count(*) as total_kmers, false as both_strands from {DATABASE}",
    "io_kmc_few": f"""select id, kmer, coalesce(c, 0) as "count" from (select id, upper(substr(sequence, 1, {adapters.K})) as kmer from sequences) left join {DATABASE} using (kmer)""",
    "io_kmer_cov": f"select * exclude (id) from ({COVERAGE})",
}
