"""Filling containers of fixed capacity (problem 9), by best-fit decreasing with a segment tree.

Sizes are whole tokens from 1 to the capacity, so items of one size are interchangeable and the whole collection is described
by a histogram of at most ``capacity`` numbers. The driver packs that histogram: sizes from large to small, each into the
tightest open container, which a segment tree over the remaining capacities finds in logarithmic time. Containers of equal
content stay together as runs of consecutive numbers, so a step places all items of a size that go to one run and the plan's
length depends on the capacity, not on the number of items. The result is the packing that best-fit decreasing gives item by item.

On the cluster each item gets its rank among the items of its size, from counts per (size, bucket) and the place in
its bucket, and looks up the step of the plan that covers the rank. No task holds all items of a size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandforge.llm import encode
from strandforge.session import materialised

CAPACITY = 2048
#: Items of one size are ranked in so many independent parts.
BUCKETS = 256


class _Tree:
    """Segment tree over 0..capacity that finds the smallest marked place from a given one on."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.base)

    def mark(self, i: int, on: bool) -> None:
        i += self.base
        self.any[i] = on
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def first_from(self, i: int) -> int:
        """The smallest marked place >= i, or -1."""
        i += self.base
        if self.any[i]:
            return i - self.base
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.base
            i >>= 1
        return -1


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best-fit decreasing of ``histogram`` (size -> items): steps (size, first rank, first container, items a container), and
    the number of containers.

    Item ``i`` of a size, from a step's first rank ``a`` on, goes to container ``first + (i - a) // per``.
    """
    tree = _Tree(capacity)
    runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by remaining capacity: (first, how many)
    steps: list[tuple[int, int, int, int]] = []
    containers = 0

    def put(remaining: int, first: int, many: int) -> None:
        if many and remaining:
            if not runs[remaining]:
                tree.mark(remaining, True)
            runs[remaining].append((first, many))

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            remaining = tree.first_from(size)
            if remaining < 0:
                remaining, first = capacity, containers
                many = -(-left // (capacity // size))
                containers += many
            else:
                first, many = runs[remaining].pop()
                if not runs[remaining]:
                    tree.mark(remaining, False)
            per = remaining // size
            took = min(left, per * many)
            steps.append((size, rank, first, per))
            full, rest = divmod(took, per)
            put(remaining - per * size, first, full)
            if rest:
                put(remaining - rest * size, first + full, 1)
            used = full + bool(rest)
            put(remaining, first + used, many - used)
            left, rank = left - took, rank + took
    return steps, containers


def _ranked(df: DataFrame, group: str, key: Column, order: list[str | Column], weight: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``weight`` over the rows before each row of its ``group``, in the order (bucket, order)."""
    df = df.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    sums = df.groupBy(group, "__b").agg(F.sum(weight).alias("__s"))
    before = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy(group, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__i", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return df.join(sums, [group, "__b"]).withColumn(name, (F.col("__o") + F.col("__i")).cast("bigint")).drop("__b", "__o", "__i")


def fill(sizes: DataFrame, key: str = "doc_id", size: str = "size", capacity: int = CAPACITY) -> DataFrame:
    """(container, key, start, length) of each piece of the items in ``sizes``; ``start`` counts from 0 within the item.

    An item above the capacity gives pieces of ``capacity`` that fill containers of their own, and a last piece that is packed
    like an item. Null sizes and sizes below 1 are left out; equal items, also with equal or null keys, are packed one by
    one. An empty table has no container. ``sizes`` is read three times, so pass a table, not a long plan.
    """
    items = sizes.select(F.col(key).alias("__key"), F.col(size).cast("bigint").alias("__size")).filter(F.col("__size") > 0)
    last = F.when(F.col("__size") > capacity, F.col("__size") % capacity).otherwise(F.col("__size"))
    packed = items.select("__key", (F.col("__size") - last).alias("__start"), last.cast("int").alias("__n")).filter("__n > 0")
    histogram = {r[0]: r[1] for r in packed.groupBy("__n").count().collect()}  # at most ``capacity`` rows
    steps, containers = plan(histogram, capacity)
    steps.sort()
    first_key = np.array([(s << 44) + r for s, r, _, _ in steps], np.int64)
    rank0, container0, per = (np.array([s[i] for s in steps], np.int64) for i in (1, 2, 3))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("__n", "__rank"))
            step = np.searchsorted(first_key, (n << 44) + rank, side="right") - 1
            at = container0[step] + (rank - rank0[step]) // per[step]
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("__key"), batch.column("__start"), pa.array(n)], names=["container", key, "start", "length"])

    kind = sizes.schema[key].dataType.simpleString()
    out = f"container bigint, `{key}` {kind}, start bigint, length bigint"
    ranked = _ranked(packed, "__n", F.struct("__key", "__start"), ["__key", "__start"], F.lit(1), "__rank")
    small = ranked.select("__n", "__rank", "__key", "__start").mapInArrow(place, out)

    whole = items.filter(F.col("__size") > capacity).select("__key", F.floor(F.col("__size") / capacity).cast("bigint").alias("__m"), F.lit(0).alias("__g"))
    whole = _ranked(whole, "__g", F.col("__key"), ["__key", "__m"], F.col("__m"), "__first")
    whole = whole.select("__key", "__first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__m") - 1)).alias("__p"))
    large = whole.select(
        (F.lit(containers) + F.col("__first") + F.col("__p")).cast("bigint").alias("container"), F.col("__key").alias(key), (F.col("__p") * capacity).cast("bigint").alias("start"), F.lit(capacity).cast("bigint").alias("length")
    )
    return small.unionByName(large)


def fill_documents(documents: DataFrame, capacity: int = CAPACITY, path: str = encode.VOCABULARY) -> DataFrame:
    """Containers of the documents, sized by the tokens of ``text``: (container, doc_id, start, length)."""
    return fill(materialised(encode.count_column(documents, path=path), "p9-sizes"), capacity=capacity)


def usage(filled: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least number of containers that could hold them, and the unused share."""
    got = filled.agg(F.countDistinct("container").alias("containers"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))
    least = F.ceil(F.col("tokens") / capacity).cast("bigint")
    return got.select("containers", "tokens", least.alias("least"), F.when(F.col("containers") > 0, 1.0 - F.col("tokens") / (F.col("containers") * capacity)).otherwise(0.0).alias("unused"))


def checked(documents: DataFrame, capacity: int = CAPACITY, path: str = encode.VOCABULARY) -> DataFrame:
    """One row about ``fill_documents``: n_documents that were placed; wrong_documents whose pieces don't cover them once, or are more than
    their size needs; overfull containers; and ``dense``, whether at most 1 % and one container more are used than the least
    possible number. ``doc_id`` must be unique here."""
    sizes = materialised(encode.count_column(documents, path=path), "p9-sizes")
    pieces = materialised(fill(sizes, capacity=capacity), "p9-pieces")
    size = sizes.filter("size > 0").select("doc_id", F.col("size").cast("bigint").alias("__size"))
    per = pieces.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"), F.sum("length").alias("sum"), F.max(F.col("start") + F.col("length")).alias("end"), F.count_distinct("start").alias("starts"))
    both = size.join(per, "doc_id", "full")
    right = (F.col("sum") == F.col("__size")) & (F.col("end") == F.col("__size")) & (F.col("starts") == F.col("m")) & (F.col("m") == F.ceil(F.col("__size") / capacity))
    docs = both.agg(F.count("m").alias("n_documents"), F.count_if(~F.coalesce(right, F.lit(False))).alias("wrong_documents"))
    full = pieces.groupBy("container").agg(F.sum("length").alias("held")).agg(F.count_if(F.col("held") > capacity).alias("overfull"), F.count(F.lit(1)).alias("__c"), F.coalesce(F.sum("held"), F.lit(0)).alias("__t"))
    one = docs.crossJoin(F.broadcast(full))  # a row each
    return one.select("n_documents", "wrong_documents", "overfull", (F.col("__c") * 100 <= F.ceil(F.col("__t") / capacity) * 101 + 100).alias("dense"))
