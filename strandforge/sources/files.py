"""File names: extensions, compression, listing, default output names; lists and maps that users write."""

from __future__ import annotations

import fnmatch
import gzip
import io
import os
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession

from strandforge.errors import InvalidExtension, InvalidInput, MalformedFile

# Extensions of the formats, and of compressed files.
FASTA_EXTENSIONS = ("fasta", "fa", "fna", "faa", "ffn", "frn")
FASTQ_EXTENSIONS = ("fastq", "fq")
COMPRESSED_EXTENSIONS = ("gz", "bgz", "bz2", "xz", "zst")

#: Bits of a record's place within its file; above them, ``id`` has the file's number in the order of the listing.
PLACE_BITS = 40


def has_extension(path: str, allowed: tuple[str, ...], gz: bool = True) -> bool:
    """Whether the name ends in an allowed extension, case ignored, perhaps followed by .gz."""
    name = os.path.basename(path).lower()
    if name.endswith(".gz"):
        if not gz:
            return False
        name = name[:-3]
    return "." in name and name.rsplit(".", 1)[1] in allowed


def require_extension(path: str, allowed: tuple[str, ...], gz: bool = True) -> None:
    if not has_extension(path, allowed, gz):
        raise InvalidExtension(f"{path}: expected an extension of {', '.join(allowed)}" + (", perhaps with .gz" if gz else ""))


def is_compressed(path: str) -> bool:
    """S12."""
    return "." in os.path.basename(path) and path.rsplit(".", 1)[1].lower() in COMPRESSED_EXTENSIONS


def _storage(path: str):
    """The file system of a path or URI (file, hdfs, s3, ...), the path on it, and what to put before its paths again."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path, ""
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[: path.index(inner)] if inner in path else path.split("://")[0] + "://"


def open_raw(path: str) -> BinaryIO:
    """The file's bytes as they are, for reading at any place."""
    if "://" not in path:
        return open(path, "rb")  # noqa: SIM115
    system, inner, _ = _storage(path)
    return io.BufferedReader(system.open_input_file(inner), 1 << 20)


def open_bytes(path: str) -> BinaryIO:
    """The file's bytes, inflated if the name ends in .gz; members follow each other."""
    raw = open_raw(path)
    return gzip.GzipFile(fileobj=raw) if path.lower().endswith(".gz") else raw


def byte_size(path: str) -> int:
    system, inner, _ = _storage(path)
    return system.get_file_info(inner).size or 0


def listed(path: str, allowed: tuple[str, ...] | None) -> list[str]:
    """The files that a path, folder or pattern names, in order; those of a folder by extension. URIs give URIs.

    A pattern may stand in the last part of the path. ``allowed`` None takes any file.
    """
    from pyarrow import fs

    system, inner, head = _storage(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        names = [f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File]
        return sorted(head + n for n in names if allowed is None or has_extension(n, allowed))
    if info.type == fs.FileType.File:
        found = [path]
    elif any(c in inner for c in "*?["):
        folder = os.path.dirname(inner) or "."
        names = [f.path for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.File]
        found = sorted(head + n for n in names if fnmatch.fnmatchcase(os.path.basename(n), os.path.basename(inner)))
    else:
        found = []
    for p in found or [path]:
        if allowed is not None:
            require_extension(p, allowed)
    if not found:
        raise FileNotFoundError(path)
    return found


def with_suffix(path: str, suffix: str) -> str:
    """``suffix`` before the extension, and before .gz: a.fa.gz -> a.<suffix>.fa.gz."""
    tail = ""
    if path.endswith(".gz"):
        path, tail = path[:-3], ".gz"
    dot = path.rfind(".")
    return f"{path[:dot]}.{suffix}{path[dot:]}{tail}" if dot >= 0 else f"{path}.{suffix}{tail}"


def inside_name(path: str, part: str) -> str:
    """``<stem>.<part>.<ext>`` by the last dot of the file's name, .gz not treated apart."""
    folder, name = os.path.split(path)
    stem, dot, ext = name.rpartition(".")
    return os.path.join(folder, f"{stem}.{part}.{ext}" if dot else f"{name}.{part}")


def kmc_prefix(path: str) -> str:
    """The database's name without .kmc_pre or .kmc_suf."""
    for end in (".kmc_pre", ".kmc_suf"):
        if path.endswith(end):
            return path[: -len(end)]
    return path


def target_names(inline: list[str] | None = None, path: str | None = None) -> list[str]:
    """Names given inline, then those of a file (blank lines and # comments skipped); first of repeated ones."""
    names = [n.strip() for n in inline or []]
    if path:
        with open(path, encoding="utf-8") as f:
            names += [line for raw in f if (line := raw.strip()) and not line.startswith("#")]
    names = list(dict.fromkeys(n for n in names if n))
    if not names:
        raise InvalidInput("no sequence names to extract")
    return names


def target_frame(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "ord bigint, name string")


def rename_pairs(path: str) -> list[tuple[int, str, str]]:
    """(line number, old, new) of a tab-separated map; lines without two non-empty fields are skipped."""
    out = []
    with open(path, encoding="utf-8") as f:
        for i, raw in enumerate(f):
            line = raw.strip()
            if not line or line.startswith("#"):
                continue
            fields = [x.strip() for x in line.split("\t")]
            if len(fields) >= 2 and fields[0] and fields[1]:
                out.append((i, fields[0], fields[1]))
    return out


def rename_frame(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(rename_pairs(path), "ord bigint, old_name string, new_name string")


def read_faidx(spark: SparkSession, path: str) -> DataFrame:
    """Index rows with their line number ``ord``, for files of any size. A short row or a bad number is an error."""
    from pyspark.sql import functions as F

    rows = spark.read.text(path).withColumn("f", F.split("value", "\t")).filter(F.trim("value") != "")
    # the place of a line in the file: rows of one file come in order within a split, and splits are numbered in order
    rows = rows.withColumn("ord", F.monotonically_increasing_id())
    bad = F.raise_error(F.concat(F.lit("malformed .faidx entry: "), F.col("value")))
    field = lambda i: F.when(F.size("f") < 6, bad.cast("string")).otherwise(F.get("f", F.lit(i)))
    number = lambda i: field(i).cast("bigint")
    desc = F.when(field(5) == ".", "").otherwise(field(5))
    return rows.select("ord", field(0).alias("name"), number(1).alias("length"), number(2).alias("offset"), number(3).alias("line_bases"), number(4).alias("line_width"), desc.alias("description"))


def load_faidx(path: str) -> dict[str, tuple[int, int, int, int, str]]:
    """S7 for point look-ups on the driver: name -> (length, offset, line_bases, line_width, description), the last of a name."""
    rows = {}
    with open(path, encoding="utf-8") as f:
        for raw in f:
            if not raw.strip():
                continue
            x = raw.rstrip("\r\n").split("\t")
            if len(x) < 6:
                raise MalformedFile(f"malformed .faidx entry: {raw.strip()}")
            try:
                rows[x[0]] = (*map(int, x[1:5]), "" if x[5] == "." else x[5])
            except ValueError as e:
                raise MalformedFile(f"malformed .faidx entry: {raw.strip()}") from e
    return rows
