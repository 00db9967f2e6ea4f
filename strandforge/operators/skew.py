"""Per-key results when a few keys hold most rows (problem 2).

The keys to salt are found first by one partial count that reads the key columns only and gives the number of all rows as well.
Their rows get a salt, partial results are computed per (key, salt), and a second stage merges the partials by the original
key. Which keys are heavy in the result is decided by the merged number of rows.

The salt comes from a row's place in its scan, not from its content, so a key whose rows are all equal is split like any
other; light keys keep one salt and cost one extra row each in the merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandforge.session import materialised

#: kind -> (partial aggregate, merge of partials). ``mean`` is a sum and a count until the end.
_KINDS = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


def key_counts(df: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Rows of each key (the key columns and ``n_rows``), written once to the shared folder, and the number of all rows.

    A key with a null in any of its columns counts as a key here (nulls equal each other).
    """
    counts = materialised(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")), "p2-keys")
    return counts, int(counts.agg(F.sum("n_rows")).first()[0] or 0)


def heavy_keys(counts: DataFrame, one_in: int, total: int) -> DataFrame:
    """The keys of ``counts`` that hold at least 1/``one_in`` of the ``total`` rows.

    There are at most ``one_in`` such keys whatever the data, so the result may be broadcast. No rows have no heavy keys.
    """
    return counts.filter((F.col("n_rows") * one_in >= F.lit(total)) & F.lit(total > 0))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], right_names: list[str]) -> Column:
    cond = F.lit(True)
    for a, b in zip(keys, right_names):
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def salt(salts: int, unique: str | None = None) -> Column:
    """A number below ``salts`` for each row, by its partition and place there, or by a hash of the column ``unique``.

    The place is the same whenever a task runs again over its part of a file. Rows that come from a shuffle have no such place: give
    a column that tells them apart.
    """
    if unique is not None:
        return F.pmod(F.xxhash64(unique), F.lit(salts)).cast("int")
    # the partition's number moves where its first rows go, else every task would begin with salt 0
    return F.pmod(F.monotonically_increasing_id() + F.spark_partition_id() * 7, F.lit(salts)).cast("int")


def salted(df: DataFrame, keys: list[str], needed: list[str], heavy: DataFrame, salts: int, unique: str | None = None) -> DataFrame:
    """The columns of the keys (``__k0``...), the values (``__v0``...) and ``__salt``, which is 0 for keys that aren't heavy.

    Only these columns of ``df`` are read, with ``unique`` if it is given.
    """
    hk = [f"__hk{i}" for i in range(len(keys))]
    heavy = heavy.select(*[F.col(k).alias(h) for k, h in zip(keys, hk)], F.lit(True).alias("__heavy"))
    work = df.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        *[F.col(c).alias(f"__v{i}") for i, c in enumerate(needed)],
        salt(salts, unique).alias("__place"),
    )
    marked = work.join(F.broadcast(heavy), _null_safe(work, heavy, [f"__k{i}" for i in range(len(keys))], hk), "left")
    return marked.withColumn("__salt", F.when(F.col("__heavy"), F.col("__place")).otherwise(F.lit(0))).drop(*hk, "__place", "__heavy")


def salted_aggregate(
    df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str | None]], one_in: int = 100, salts: int = 64, unique: str | None = None
) -> DataFrame:
    """Two-stage aggregation of ``df`` by ``keys``: one row per key, the named aggregates and ``is_heavy``.

    ``aggs`` maps an output name to (kind, column); kind is count, sum, min, max or mean, and ``("count", None)``
    counts rows. Heavy keys are those with at least 1/``one_in`` of the rows. ``df`` should be a scan; for rows that come from a
    shuffle name a ``unique`` column (see ``salt``).

    Nulls: rows whose key holds a null form groups like any other; null values are left out of sum, min, max and
    mean, a group with only null values gives null. Repeated rows count as they stand, and copies of one row are spread over the
    salts. An empty table gives no rows. Columns of ``df`` that are neither keys nor aggregated aren't read; their names can't
    clash, because the operator works on its own column names.
    """
    needed = list(dict.fromkeys([c for _, c in aggs.values() if c is not None]))
    counts, total = key_counts(df.select(*keys), keys)
    marked = salted(df, keys, needed, heavy_keys(counts, one_in, total), salts, unique)
    k = [f"__k{i}" for i in range(len(keys))]
    value = {c: f"__v{i}" for i, c in enumerate(needed)}

    partial, merge, final = [], [], []
    for name, (kind, column) in aggs.items():
        src = F.lit(1) if column is None else F.col(value[column])
        if kind == "mean":
            partial += [F.sum(src).alias(f"__s_{name}"), F.count(src).alias(f"__c_{name}")]
            merge += [F.sum(f"__s_{name}").alias(f"__s_{name}"), F.sum(f"__c_{name}").alias(f"__c_{name}")]
            final.append((F.col(f"__s_{name}").cast("double") / F.col(f"__c_{name}")).alias(name))
        else:
            first, second = _KINDS[kind]
            partial.append(first(src).alias(f"__p_{name}"))
            merge.append(second(f"__p_{name}").alias(f"__p_{name}"))
            final.append(F.col(f"__p_{name}").alias(name))
    stage1 = marked.groupBy(*k, "__salt").agg(*partial, F.count(F.lit(1)).alias("__rows"))
    stage2 = stage1.groupBy(*k).agg(*merge, F.sum("__rows").alias("__rows"))
    return stage2.select(*[F.col(a).alias(b) for a, b in zip(k, keys)], *final, (F.col("__rows") * one_in >= F.lit(total)).alias("is_heavy"))


def bin_totals(bins: DataFrame, one_in: int = 100, salts: int = 64) -> DataFrame:
    """Rows and ``pair_count`` sum of each non-null (chrom1, bin1), and whether the key is heavy.

    Heavy is a share of all rows, those with null keys included.
    """
    got = salted_aggregate(bins, ["chrom1", "bin1"], {"n_rows": ("count", None), "pair_sum": ("sum", "pair_count")}, one_in, salts)
    return got.filter(F.col("chrom1").isNotNull() & F.col("bin1").isNotNull())


def ref_totals(alignments: DataFrame, one_in: int = 20, salts: int = 64) -> DataFrame:
    """Rows and mean ``mapq`` of each ``ref_id`` >= 0, and whether it is heavy (a share of all rows)."""
    got = salted_aggregate(alignments, ["ref_id"], {"n_rows": ("count", None), "mean_mapq": ("mean", "mapq")}, one_in, salts)
    return got.filter(F.col("ref_id") >= 0)


def heavy_found(bins: DataFrame, alignments: DataFrame) -> DataFrame:
    """The heavy keys of both tables as (kind, key)."""
    b = bin_totals(bins).filter("is_heavy").select(F.lit("bin").alias("kind"), F.concat_ws(":", "chrom1", F.col("bin1").cast("string")).alias("key"))
    r = ref_totals(alignments).filter("is_heavy").select(F.lit("ref").alias("kind"), F.col("ref_id").cast("string").alias("key"))
    return b.unionByName(r)
