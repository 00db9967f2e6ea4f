"""The eleven commands: ``python -m strandforge <command> ...``. Outputs go beside the input unless -o says otherwise."""

from __future__ import annotations

import argparse
import logging
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from strandforge.operators import fasta, fastq, flagstat, hic, kmers
from strandforge.sources import bam as bam_source
from strandforge.sources import fasta as fasta_source
from strandforge.sources import fastq as fastq_source
from strandforge.sources import files, kmc, sinks

log = logging.getLogger("strandforge")

#: More requested names than this are looked up by a scan, where the first record of a name holds; fewer by the index, where the last does.
SCAN_ABOVE = 1000


def _one(df: DataFrame) -> dict:
    return df.first().asDict()


def _report(title: str, rows: list[tuple[str, str]]) -> None:
    log.info("%s", f" {title} ".center(54, "="))
    for label, value in rows:
        log.info("%-30s : %s", label, value)


def _table(rows: DataFrame, out: str, parts: bool, header: bool = False, decimals: dict[str, int] | None = None) -> None:
    """One file through the driver, or with --parts a folder of parts without header, written by all tasks."""
    if parts:
        sinks.write_tsv_folder(rows, out, decimals=decimals)
    else:
        sinks.write_tsv(rows, out, [], header, decimals)


def _records(spark: SparkSession, path: str) -> DataFrame:
    files.require_extension(path, files.FASTA_EXTENSIONS)
    return fasta_source.read_fasta(spark, path)


def fa_length(spark: SparkSession, a: argparse.Namespace) -> str:
    out = f"{a.fname}.len"
    rows = fasta.lengths(_records(spark, a.fname)).orderBy("id").select("name", "length")
    sinks.write_tsv(rows, out, [])
    return out


def fa_stats(spark: SparkSession, a: argparse.Namespace) -> str:
    out = f"{a.fname}.summary.tsv"
    rows = sinks.fasta_stats_rows(a.fname, _one(fasta.stats(_records(spark, a.fname))))
    _report("SUMMARY", rows)
    sinks.write_lines(("\t".join(r) for r in rows), out)
    return out


def fa_rename(spark: SparkSession, a: argparse.Namespace) -> str:
    out = a.out or files.with_suffix(a.fname, "renamed")
    names = files.rename_frame(spark, a.map)
    if names.isEmpty():
        log.warning("no valid pairs in %s; records stay as they are", a.map)
    records = fasta.rename(_records(spark, a.fname), names, a.keep_old_id)
    n = sinks.write_fasta(records, out, a.width)
    log.info("%d records written to %s", n, out)
    return out


def fa_filter(spark: SparkSession, a: argparse.Namespace) -> str:
    out = files.with_suffix(a.fname, "filtered")
    records = _records(spark, a.fname)
    kept = fasta.filter_records(records, a.min_len, a.max_len, a.min_gc)
    sinks.write_fasta(kept, out, 80)
    c = _one(fasta.filter_counts(records, min_len=a.min_len, max_len=a.max_len, min_gc=a.min_gc))
    log.info("removed %d, kept %d of %d records in %s", c["removed"], c["passed"], c["total"], out)
    return out


def _index(path: str) -> str:
    out = f"{path}.faidx"
    sinks.write_lines(("\t".join(map(str, r)) for r in fasta_source.build_index(path)), out)
    return out


def fa_fai(spark: SparkSession | None, a: argparse.Namespace) -> str:
    return _index(a.fname)


def _indexed(path: str) -> dict[str, tuple[int, int, int, int, str]]:
    """The index beside a plain file, built if there is none. An index that is older than its file is used as it is."""
    if not os.path.exists(f"{path}.faidx"):
        _index(path)
    return files.load_faidx(f"{path}.faidx")


def _fasta_lines(name: str, desc: str, seq: str, width: int | None) -> list[str]:
    body = [seq[i : i + width] for i in range(0, len(seq), width)] if width else [seq]
    return [f">{name}" + (f" {desc}" if desc else ""), *body]


def _some_by_index(spark: SparkSession, path: str, names: list[str], width: int | None, out: str) -> bool:
    """Few records by ranged reads, in the order asked for; False where the file's lines don't allow it.

    Names that the index lacks are looked up by a scan, whose rules for headers are wider.
    """
    index, found = _indexed(path), {}
    if "" in index:
        log.warning("%s: headers that the index has without a name; reading the whole file", path)
        return False
    try:
        for name in names:
            if name in index:
                found[name] = fasta_source.fetch(path, index[name], name)
                if any(c in found[name][2] for c in " \t\f>"):
                    raise files.MalformedFile(f"{path}: lines of '{name}' hold blanks or a header")
    except files.MalformedFile as e:
        log.warning("%s; reading the whole file", e)
        return False
    missing = [n for n in names if n not in found]
    if missing:
        for r in fasta.some_records(_records(spark, path), files.target_frame(spark, missing), "last").toLocalIterator():
            found[r["name"]] = (r["name"], r["description"], r["sequence"])
    sinks.write_lines([line for n in names if n in found for line in _fasta_lines(*found[n], width)], out)
    for name in missing:
        if name not in found:
            log.warning("record '%s' not found", name)
    log.info("extracted %d of %d requested records", len(found), len(names))
    return True


def fa_one_record(spark: SparkSession | None, a: argparse.Namespace) -> str:
    files.require_extension(a.fname, files.FASTA_EXTENSIONS, gz=False)
    entry = _indexed(a.fname).get(a.name)
    if entry is None:
        raise files.InvalidInput(f"record '{a.name}' not found in the index")
    name, desc, seq = fasta_source.fetch(a.fname, entry, a.name)
    out = a.out or files.inside_name(a.fname, a.name)
    sinks.write_lines(_fasta_lines(name, desc, seq, a.width), out)
    return out


def fa_some_records(spark: SparkSession, a: argparse.Namespace) -> str:
    inline = [n for part in a.names or [] for n in part.split(",")]
    names = files.target_names(inline, a.query)
    out = a.out or files.inside_name(a.fname, "some")
    if len(names) <= SCAN_ABOVE and files.has_extension(a.fname, files.FASTA_EXTENSIONS, gz=False) and _some_by_index(spark, a.fname, names, a.width, out):
        return out
    wanted = files.target_frame(spark, names)
    records = _records(spark, a.fname)
    found = fasta.some_records(records, wanted, "first" if len(names) > SCAN_ABOVE else "last")
    n = sinks.write_fasta(found, out, a.width, "ord")
    for r in fasta.missing_records(records, wanted).orderBy("ord").toLocalIterator():
        log.warning("record '%s' not found", r["name"])
    log.info("extracted %d of %d requested records", n, len(names))
    return out


def fq_stats(spark: SparkSession, a: argparse.Namespace) -> str:
    files.require_extension(a.fname, files.FASTQ_EXTENSIONS)
    out = f"{a.fname}.summary.tsv"
    rows = sinks.fastq_stats_rows(a.fname, _one(fastq.stats(fastq_source.read_fastq(spark, a.fname))))
    _report("SUMMARY", rows)
    sinks.write_lines(("\t".join(r) for r in rows), out)
    return out


def _kmc_info(prefix: str) -> kmc.Header:
    h = kmc.read_header(prefix)
    _report("KMC INFO", [(k.replace("_", " "), str(v)) for k, v in vars(h).items()])
    if h.mode:
        log.warning("mode %d: counts aren't whole numbers in this database and are read as such", h.mode)
    if h.version != kmc.VERSION:
        log.error("KMC version is 0x%x, not 0x%x", h.version, kmc.VERSION)
    return h


def dump_kmc(spark: SparkSession, a: argparse.Namespace) -> str:
    prefix = files.kmc_prefix(a.prefix)
    _kmc_info(prefix)
    out = a.out or f"{prefix}.dump.tsv"
    _table(kmc.read_kmc(spark, prefix, in_memory=a.in_memory), out, a.parts)
    return out


def fa_kmer_cov(spark: SparkSession, a: argparse.Namespace) -> str:
    prefix = files.kmc_prefix(a.kmc)
    h = _kmc_info(prefix)
    db = kmc.read_kmc(spark, prefix, in_memory=a.in_memory)
    if a.canonical and not h.both_strands:  # a database of both strands holds canonical k-mers already
        db = kmers.folded(db)
    rows = kmers.coverage(_records(spark, a.ref), db, h.kmer_length, a.canonical).orderBy("id").drop("id")
    _table(rows, a.out, a.parts, header=True, decimals={"mean_ref": 4, "mean_query": 4})
    return a.out


def hic_contact_matrix(spark: SparkSession, a: argparse.Namespace) -> str:
    limits = hic.PairFilter(a.min_mapq, a.max_nm, a.min_as)
    if a.bin_size <= 0:
        raise files.InvalidInput("bin size must be above 0")
    rows = bam_source.read_bam(spark, a.input, "name").drop("sequence", "quality").persist()
    _report("FLAGSTAT SUMMARY", sinks.flagstat_rows(_one(flagstat.percentages(flagstat.flagstat(rows)))))
    bins = hic.binned(hic.contacts(rows, bam_source.read_refs(spark, a.input), limits), a.bin_size).persist()
    _report("MATRIX SUMMARY", sinks.matrix_rows(a.input, a.bin_size, limits, _one(hic.summary(bins))))
    out = f"{a.input}.{a.bin_size}bp.matrix.tsv"
    _table(hic.matrix(bins).orderBy("chrom1", "bin1", "chrom2", "bin2"), out, a.parts, header=True)
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandforge")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *options: tuple) -> None:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for flags, kw in options:
            c.add_argument(*flags, **kw)

    fname = (("-f", "--fname"), {"required": True})
    out = (("-o", "--out"), {})
    width = (("-w", "--width"), {"type": int})
    threads = (("-t", "--threads"), {"type": int, "default": 2})
    memory = (("--in-memory",), {"action": "store_true"})
    parts = (("--parts",), {"action": "store_true"})
    command("fa-length", fa_length, fname)
    command("fa-stats", fa_stats, fname)
    command("fa-rename", fa_rename, fname, (("-m", "--map"), {"required": True}), out, (("--keep-old-id",), {"action": "store_true"}), (("-w", "--width"), {"type": int, "default": 80}))
    command("fa-filter", fa_filter, fname, (("-m", "--min-len"), {"type": int}), (("-M", "--max-len"), {"type": int}), (("-g", "--min-gc"), {"type": float}))
    command("fa-fai", fa_fai, fname)
    command("fa-one-record", fa_one_record, fname, (("-n", "--name"), {"required": True}), out, width)
    command("fa-some-records", fa_some_records, fname, (("-q", "--query"), {}), (("-n", "--names"), {"nargs": "+"}), out, width)
    command("fq-stats", fq_stats, fname, threads)
    command("dump-kmc", dump_kmc, (("-p", "--prefix"), {"required": True}), out, (("-i", *memory[0]), memory[1]), parts)
    command("fa-kmer-cov", fa_kmer_cov, (("-r", "--ref"), {"required": True}), (("-k", "--kmc"), {"required": True}), (("-o", "--out"), {"required": True}), (("-m", *memory[0]), memory[1]), threads, (("--canonical",), {"action": "store_true"}), parts)
    command(
        "hic-contact-matrix", hic_contact_matrix, (("-i", "--input"), {"required": True}), (("-b", "--bin-size"), {"type": int, "required": True}), threads,
        (("-q", "--min-mapq"), {"type": int, "default": 30}), (("--max-nm",), {"type": int, "default": 5}), (("--min-as",), {"type": int, "default": 100}), parts,
    )
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one command; 0, or 1 after an error that is logged."""
    logging.basicConfig(level=os.environ.get("LOG_LEVEL", "INFO").upper(), format="%(asctime)s %(levelname)s %(message)s")
    a = parser().parse_args(argv)
    began = time.time()
    own = None
    try:
        if spark is None and a.run not in (fa_fai, fa_one_record):
            threads = getattr(a, "threads", None)
            spark = own = SparkSession.builder.master(os.environ.get("SPARK_MASTER", f"local[{threads or '*'}]")).config("spark.ui.enabled", "false").getOrCreate()
        log.info("wrote %s", a.run(spark, a))
    except Exception as e:  # noqa: BLE001
        log.error("%s", e)
        return 1
    finally:
        if own is not None:
            own.stop()
    log.info("elapsed %s", sinks.duration(time.time() - began))
    return 0


if __name__ == "__main__":
    sys.exit(main())
