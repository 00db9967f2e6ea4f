"""FASTA operators: records are (id, name, description, sequence, ...) rows; ``id`` is unique and orders them by file and place.

Nulls: a null sequence counts as empty, a null description as none. Other columns pass through where records do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandforge.functions import seq as S

#: The cumulative length classes of the statistics.
LENGTH_CLASSES = {"100bp": 100, "200bp": 200, "500bp": 500, "1kb": 1000, "2kb": 2000, "10kb": 10_000, "1mb": 1_000_000, "10mb": 10_000_000}


def _seq() -> Column:
    return F.coalesce(F.col("sequence"), F.lit(""))


def lengths(records: DataFrame) -> DataFrame:
    """(id, name, length)."""
    return records.select("id", "name", S.seq_length(_seq()).alias("length"))


def filter_records(records: DataFrame, min_len: int | None = None, max_len: int | None = None, min_gc: float | None = None) -> DataFrame:
    """records with min_len <= length <= max_len and a GC percentage of at least min_gc."""
    out = records
    if min_len is not None:
        out = out.filter(S.seq_length(_seq()) >= min_len)
    if max_len is not None:
        out = out.filter(S.seq_length(_seq()) <= max_len)
    if min_gc is not None:
        out = out.filter(S.gc_pct(_seq()) >= float(min_gc))
    return out


def filter_counts(records: DataFrame, **limits: float | None) -> DataFrame:
    """(total, passed, removed) of a filter, in one pass."""
    keep = F.lit(True)
    if limits.get("min_len") is not None:
        keep = keep & (S.seq_length(_seq()) >= limits["min_len"])
    if limits.get("max_len") is not None:
        keep = keep & (S.seq_length(_seq()) <= limits["max_len"])
    if limits.get("min_gc") is not None:
        keep = keep & (S.gc_pct(_seq()) >= float(limits["min_gc"]))
    got = records.agg(F.count(F.lit(1)).alias("total"), F.count_if(keep).alias("passed"))
    return got.withColumn("removed", F.col("total") - F.col("passed"))


def nx(records: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """For each fraction the first length, from long to short, at which the sum reaches trunc(total * fraction).

    Equal lengths are collapsed first, so the ordered pass sees each different length once. No records give 0.
    """
    per = records.select(S.seq_length(_seq()).alias("len")).groupBy("len").agg(F.count(F.lit(1)).alias("n"))
    ordered = per.withColumn("upto", F.sum(F.col("len") * F.col("n")).over(Window.orderBy(F.desc("len"))))
    total = per.agg(F.coalesce(F.sum(F.col("len") * F.col("n")), F.lit(0)).alias("total"))
    both = ordered.join(F.broadcast(total))  # the total is one row
    aggs = [F.coalesce(F.max(F.when(F.col("upto") >= (F.col("total") * F.lit(float(f))).cast("bigint"), F.col("len"))), F.lit(0)).cast("bigint").alias(n) for n, f in fractions.items()]
    return both.agg(*aggs)


def stats(records: DataFrame, gc: bool = False) -> DataFrame:
    """A1 to A5: one row of whole-file statistics. ``gc`` adds the percentage of G and C over all letters.

    avg_length is a whole-number quotient; non_atgc_bases counts N only. No records give zeros.
    """
    n = S.seq_length(_seq())
    aggs = [
        F.count(F.lit(1)).alias("num_sequences"),
        F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("total_length"),
        F.coalesce(F.min(n), F.lit(0)).alias("min_length"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_length"),
        F.coalesce(F.sum(S.n_count(_seq())), F.lit(0)).cast("bigint").alias("non_atgc_bases"),
        *[F.count_if(n >= at).alias(f"count_ge_{name}") for name, at in LENGTH_CLASSES.items()],
    ]
    if gc:
        aggs.append(F.coalesce(F.sum(S.letter_count(_seq(), "GCgc")), F.lit(0)).alias("gc"))
    one = records.agg(*aggs)
    total, count = F.col("total_length"), F.col("num_sequences")
    one = one.withColumn("avg_length", F.when(count > 0, F.floor(total / F.when(count > 0, count))).otherwise(0).cast("bigint"))
    one = one.withColumn("non_atgc_pct", F.when(total > 0, F.col("non_atgc_bases") / F.when(total > 0, total) * 100.0).otherwise(0.0))
    if gc:
        one = one.withColumn("gc_pct", F.when(total > 0, F.col("gc") / F.when(total > 0, total) * 100.0).otherwise(0.0)).drop("gc")
    return one.join(F.broadcast(nx(records, {"n50": 0.5, "n90": 0.9})))  # one row each


def rename(records: DataFrame, name_map: DataFrame, keep_old_id: bool = False) -> DataFrame:
    """Names replaced by the map's (old_name, new_name); of repeated old names the row with the largest ``ord`` holds.

    With keep_old_id the description of renamed records gets ``old_id=<old>``, after a space if there is one already. The
    map is broadcast by Spark where it is small; beyond that the join shuffles by name.
    """
    last = name_map.filter(F.col("old_name").isNotNull() & F.col("new_name").isNotNull()).groupBy(F.col("old_name").alias("__old")).agg(F.max_by("new_name", "ord").alias("__new"))
    out = records.join(last, F.col("name") == F.col("__old"), "left").drop("__old")
    if keep_old_id:
        tag = F.concat(F.lit("old_id="), F.col("name"))
        blank = F.coalesce(F.trim("description"), F.lit("")) == ""
        described = F.when(blank, tag).otherwise(F.concat(F.col("description"), F.lit(" "), tag))
        out = out.withColumn("description", F.when(F.col("__new").isNotNull(), described).otherwise(F.col("description")))
    return out.withColumn("name", F.coalesce("__new", "name")).drop("__new")


def rename_counts(records: DataFrame, name_map: DataFrame) -> DataFrame:
    """(total, renamed) of a renaming, in one row."""
    old = name_map.filter(F.col("old_name").isNotNull() & F.col("new_name").isNotNull()).select(F.col("old_name").alias("__old")).distinct()
    hit = records.select("name").join(old, F.col("name") == F.col("__old"), "left")
    return hit.agg(F.count(F.lit(1)).alias("total"), F.count("__old").alias("renamed"))


def targets(names: DataFrame) -> DataFrame:
    """(ord, name) of requested names: trimmed, blanks dropped, the first of repeated ones."""
    got = names.select(S.trim_blank("name").alias("name"), "ord").filter(F.coalesce(F.col("name"), F.lit("")) != "")
    return got.groupBy("name").agg(F.min("ord").alias("ord"))


def _one_each(records: DataFrame, duplicates: str) -> DataFrame:
    """One record a name: the ``first`` or ``last`` by id."""
    pick = {"last": F.max_by, "first": F.min_by}[duplicates]
    row = F.struct(*records.columns)
    return records.groupBy("name").agg(pick(row, F.col("id")).alias("__r")).select("__r.*")


def some_records(records: DataFrame, wanted: DataFrame, duplicates: str = "last") -> DataFrame:
    """The requested records with ``ord``, to be ordered by it; of equal names the last or first record.

    A column ``ord`` of the records gives way to that of the request.
    """
    records = records.drop("ord")
    few = records.join(wanted.select("name"), "name", "left_semi")
    return _one_each(few.select(*records.columns), duplicates).join(wanted, "name")


def missing_records(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requested names (ord, name) without a record."""
    return wanted.join(records.select("name"), "name", "left_anti").select("ord", "name")


def extraction_counts(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """(requested, found) of an extraction, in one row."""
    hit = wanted.join(records.select("name").distinct().withColumn("__f", F.lit(1)), "name", "left")
    return hit.agg(F.count(F.lit(1)).alias("requested"), F.count("__f").alias("found"))


def one_record(records: DataFrame, name: str, duplicates: str = "last") -> DataFrame:
    """The record of a name (the last or first of several), or no row."""
    return _one_each(records.filter(F.col("name") == name), duplicates)


def region(records: DataFrame, start: Column, length: Column) -> DataFrame:
    """A part of each record, 0-based and capped at its end; a start at or beyond the end is an error."""
    n = S.seq_length(_seq())
    checked = F.when(start >= n, F.raise_error(F.concat(F.lit("start out of bounds for sequence "), F.col("name")))).otherwise(start)
    some = F.least(length, n - checked)
    cut = F.substring(_seq(), (checked + 1).cast("int"), some.cast("int"))
    whole = (start == 0) & (some == n)
    described = F.when(some == 0, F.lit("")).otherwise(F.col("description"))
    return records.select("id", S.region_name("name", start, some, whole).alias("name"), described.alias("description"), cut.alias("sequence"))


def to_text(records: DataFrame, width: int | None = 80) -> DataFrame:
    """K1: one ``value`` a record: ``>name[ description]`` and the sequence, folded at ``width`` or in one line.

    Folded, an empty sequence has no line; unfolded it has an empty one.
    """
    desc = F.coalesce(F.col("description"), F.lit(""))
    head = F.concat(F.lit(">"), F.coalesce(F.col("name"), F.lit("")), F.when(desc != "", F.concat(F.lit(" "), desc)).otherwise(""))
    if width:
        body = F.when(_seq() == "", "").otherwise(F.concat(F.lit("\n"), S.fold(_seq(), width)))
    else:
        body = F.concat(F.lit("\n"), _seq())
    return records.select("id", F.concat(head, body).alias("value"))


def index_rows(records: DataFrame) -> DataFrame:
    """Index rows with one row a name, the last by ``ord``; descriptions ``.`` become empty."""
    row = F.struct(*[c for c in records.columns if c != "ord"])
    last = records.groupBy("file_name", "name").agg(F.max_by(row, "ord").alias("__r")).select("__r.*")
    return last.withColumn("description", F.when(F.col("description") == ".", "").otherwise(F.col("description")))
