"""Distinct counts over huge sets (problem 4), by multiresolution bitmaps kept as rows.

A 64-bit hash puts an item in slice ``l`` with probability 2**-(l+1) and there on one of ``2**slice_bits`` bits. A sketch
is the set bits as rows (group..., slice, word, mask, lo, hi) with 64 bits a word; only words with a set bit exist. ``lo`` and ``hi`` are
the smallest and largest hash that set a bit in the word. Sketches merge by OR of the masks, minimum and maximum: a union and one
aggregate per (group, slice, word), which Spark computes partly before the shuffle. No set of items is ever built: whatever
a group holds, its sketch has at most 32 * 2**slice_bits / 64 rows, 512 a slice. Coarser groups are merged from the finest sketches.

Estimate: the lowest slice that isn't saturated is the base; slices from there on hold a known share 2**-base of the items. A
slice with few bits is counted: its set bits, and one more for every word whose smallest and largest hash differ but belong to
one bit, which are two items on it. A fuller one gets its linear count, -B ln(1 - x / B). The sum is scaled by 2**base.

Error: with B = 2**15 bits the standard error is at most 0.85 / sqrt(B) = 0.47 % for sets of any size, so 3 % are 6 standard
deviations. In sets of up to some dozens of items, where one item is more than 3 %, all slices are counted, and an error
needs three items in one word of which two share a bit: about 1e-4 at 33 items, 2e-5 at 20, 3e-7 at 5. ``n_low`` and
``n_high`` say which it was: they equal the estimate where all was counted, and lie 3 % around it elsewhere.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BITS = 15
SLICES = 32
#: A slice with more than this share of its bits set is saturated.
FULL = 0.8
#: A slice with at most so many set bits a word is counted.
SPARSE = 0.25
#: The error that n_low and n_high allow for.
BOUND = 0.03
_KEPT = ("mask", "lo", "hi")


def _bit(items: list[str | Column], slice_bits: int) -> dict[str, Column]:
    """Slice, word, mask and hash of an item; a null item sets no bit but keeps its group."""
    cols = [F.col(c) if isinstance(c, str) else c for c in items]
    null = F.lit(False)
    for c in cols:
        null = null | c.isNull()
    h = F.xxhash64(*cols)
    high = F.shiftrightunsigned(h, slice_bits)
    zeros = F.when(high == 0, F.lit(SLICES - 1)).otherwise(F.lit(63 - slice_bits) - F.floor(F.log2(high.cast("double"))))
    pos = h.bitwiseAND(F.lit((1 << slice_bits) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), pos.bitwiseAND(F.lit(63)).cast("int"))
    return {
        "slice": F.when(null, F.lit(-1)).otherwise(F.least(zeros, F.lit(SLICES - 1))).cast("int"),
        "word": F.when(null, F.lit(0)).otherwise(F.shiftright(pos, 6)).cast("int"),
        "mask": F.when(null, F.lit(0).cast("bigint")).otherwise(one),
        "lo": F.when(~null, h),
        "hi": F.when(~null, h),
    }


def _merged(prefix: str = "") -> list[Column]:
    return [f(f"{prefix}{c}").alias(f"{prefix}{c}") for f, c in zip((F.bit_or, F.min, F.max), _KEPT)]


def sketch(df: DataFrame, groups: dict[str, Column], items: list[str | Column], slice_bits: int = SLICE_BITS, only: Column | None = None) -> DataFrame:
    """Sketch rows of the distinct ``items`` per group: (group..., slice, word, mask, lo, hi).

    Items with a null part aren't counted; null group values form groups. Repeated rows change nothing. An empty table
    has no sketch. ``groups`` names the result's group columns, so other columns of ``df`` can't clash. With the condition ``only`` the
    columns o_mask, o_lo and o_hi hold in the same rows the sketch of the items for which it is true.
    """
    bit = _bit(items, slice_bits)
    more = {} if only is None else {"o_mask": F.when(only, bit["mask"]).otherwise(F.lit(0).cast("bigint")), "o_lo": F.when(only, bit["lo"]), "o_hi": F.when(only, bit["hi"])}
    rows = df.select(*[c.alias(n) for n, c in groups.items()], *[c.alias(n) for n, c in (bit | more).items()])
    return merge(rows, list(groups))


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """OR of all sketch rows per group; ``groups`` may be fewer columns than the sketches were made with."""
    more = _merged("o_") if "o_mask" in sketches.columns else []
    return sketches.groupBy(*groups, "slice", "word").agg(*_merged(), *more)


def estimate(sketches: DataFrame, groups: list[str], names: dict[str, str] | str = "n_distinct", slice_bits: int = SLICE_BITS) -> DataFrame:
    """One row per group of merged sketches: the estimate, rounded to BIGINT, with <name>_low and <name>_high.

    ``names`` maps a prefix of the sketch's columns to the result's name; a text names that of the plain columns.
    """
    names = {"": names} if isinstance(names, str) else names
    size, sparse = float(1 << slice_bits), SPARSE * (1 << slice_bits) / 64
    aggs = []
    for p, name in names.items():
        bits = F.bit_count(f"{p}mask")
        lo, hi = F.col(f"{p}lo"), F.col(f"{p}hi")
        hidden = F.count_if((lo < hi) & (lo.bitwiseAND(F.lit(63)) == hi.bitwiseAND(F.lit(63))))
        aggs += [F.sum(bits).alias(f"{p}set"), hidden.alias(f"{p}hidden")]
    per = sketches.groupBy(*groups, "slice").agg(*aggs)
    lists, out = [], []
    for p, name in names.items():
        used = F.col(f"{p}set")
        few = used <= sparse
        linear = -size * F.log(1.0 - F.least(used / size, F.lit(1.0 - 0.5 / size)))
        n = F.when(F.col("slice") < 0, F.lit(0.0)).when(few, (used + F.col(f"{p}hidden")).cast("double")).otherwise(linear)
        one = F.struct(F.col("slice").alias("s"), ((F.col("slice") >= 0) & (used > FULL * size)).alias("f"), few.alias("few"), n.alias("n"))
        lists.append(F.collect_list(one).alias(f"__{p}l"))  # at most 33 entries
    got = per.groupBy(*groups).agg(*lists)
    for p, name in names.items():
        entries = f"__{p}l"
        base = F.aggregate(entries, F.lit(0), lambda a, x: F.when(x["f"] & (x["s"] + 1 > a), x["s"] + 1).otherwise(a))
        got = got.withColumn(f"__{p}b", F.least(base, F.lit(SLICES - 1)))
        total = F.aggregate(entries, F.lit(0.0), lambda a, x: a + F.when(x["s"] >= F.col(f"__{p}b"), x["n"]).otherwise(0.0))
        n = F.round(total * F.pow(F.lit(2.0), F.col(f"__{p}b"))).cast("bigint")
        counted = F.forall(entries, lambda x: x["few"])
        out += [n.alias(name), F.when(counted, n).otherwise(F.floor(n / (1 + BOUND))).cast("bigint").alias(f"{name}_low"), F.when(counted, n).otherwise(F.ceil(n / (1 - BOUND))).cast("bigint").alias(f"{name}_high")]
    return got.select(*groups, *out)


def cube(sketches: DataFrame, groups: list[str], name: str = "n_distinct", slice_bits: int = SLICE_BITS) -> DataFrame:
    """Estimates for every combination of ``groups``, merged from the finest sketches.

    ``grouping`` is Spark's grouping_id: bit i (from the right, last column first) is 1 where that column is summed over,
    which tells a null of the data from a null of the combination.
    """
    fixed = ["slice", "word"]
    sets = [[*some, *fixed] for n in range(len(groups) + 1) for some in combinations(groups, n)]
    every = sketches.groupingSets(sets, *groups, *fixed).agg(F.grouping_id().alias("__g"), *_merged())
    every = every.withColumn("grouping", F.shiftright("__g", 2).cast("int"))
    return estimate(every, [*groups, "grouping"], name, slice_bits)


def coverage_distinct(coverage: DataFrame) -> DataFrame:
    """Distinct non-null ``ref_name`` of kmer_coverage per day, sample, db_id and every combination of them."""
    day = F.to_date("measured_at")
    fine = sketch(coverage, {"day": day, "sample": F.col("sample"), "db_id": F.col("db_id")}, ["ref_name"])
    return cube(fine, ["day", "sample", "db_id"], "n_ref_names")


def coverage_error(coverage: DataFrame) -> DataFrame:
    """The estimates of ``coverage_distinct`` beside exact counts: (day, sample, db_id, grouping, n_exact, within), ``within`` being an
    error of at most 3 % of the exact count. The exact counts shuffle every name; this is a check, not the operator."""
    groups = ["day", "sample", "db_id"]
    rows = coverage.select(F.to_date("measured_at").alias("day"), "sample", "db_id", "ref_name")
    sets = [list(some) for n in range(len(groups) + 1) for some in combinations(groups, n)]
    exact = rows.groupingSets(sets, *groups).agg(F.grouping_id().cast("int").alias("grouping"), F.count_distinct("ref_name").alias("n_exact"))
    return _beside(exact, coverage_distinct(coverage).withColumnRenamed("n_ref_names", "__n"), [*groups, "grouping"], {"n_exact": "__n"})


def _beside(exact: DataFrame, sketched: DataFrame, groups: list[str], names: dict[str, str]) -> DataFrame:
    other = sketched.select(*[F.col(g).alias(f"__{g}") for g in groups], *names.values())
    on = F.lit(True)
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    within = F.lit(True)
    for e, n in names.items():
        within = within & (F.abs(F.col(n) - F.col(e)) <= BOUND * F.col(e))
    return exact.join(other, on, "full").select(*groups, *names, F.coalesce(within, F.lit(False)).alias("within"))


def _hits(stream: DataFrame, known: DataFrame) -> DataFrame:
    """(day, sample, ref_name, __key, __hit) of all rows: the hash of the key, null without one, and whether it is a known key.

    Only one row a known key is joined to, so a key with many rows gains none; its side is split where it is hot (AQE), and the known
    keys are broadcast by Spark where they are small.
    """
    key = F.when(F.col("k").isNotNull() & F.col("data").isNotNull(), F.xxhash64("k", "data"))
    rows = stream.select(F.to_date("arrived_at").alias("day"), "sample", "ref_name", key.alias("__key"))
    old = known.filter(F.col("k").isNotNull() & F.col("data").isNotNull()).select(F.xxhash64("k", "data").alias("__old")).distinct()
    return rows.join(old, F.col("__key") == F.col("__old"), "left").select("day", "sample", "ref_name", "__key", F.col("__old").isNotNull().alias("__hit"))


def stream_distinct(stream: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct keys of kmer_stream per arrival day, sample and ref_name (``ref_unique_n``), and of those the ones in known_kmers
    (``query_uniq_n``), each with its bounds.

    The rows are sketched as they stream by. Rows without a key set no bit; their groups appear with 0.
    """
    names = ["day", "sample", "ref_name"]
    rows = sketch(_hits(stream, known), {g: F.col(g) for g in names}, ["__key"], only=F.col("__hit"))
    return estimate(rows, names, {"": "ref_unique_n", "o_": "query_uniq_n"})


def stream_error(stream: DataFrame, known: DataFrame) -> DataFrame:
    """``stream_distinct`` beside exact counts: (day, sample, ref_name, exact_ref, exact_query, within). A check like coverage_error."""
    names = ["day", "sample", "ref_name"]
    exact = _hits(stream, known).groupBy(*names).agg(F.count_distinct("__key").alias("exact_ref"), F.count_distinct(F.when(F.col("__hit"), F.col("__key"))).alias("exact_query"))
    return _beside(exact, stream_distinct(stream, known), names, {"exact_ref": "ref_unique_n", "exact_query": "query_uniq_n"})
