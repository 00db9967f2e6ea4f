"""Most frequent items in bounded memory (problem 6), by lossy counting.

Every task reads its rows in chunks and keeps entries (item, count, delta): ``delta`` is the most the item can have
occurred before its entry was made. With buckets of ``width = 1 / eps`` rows, an entry is dropped at a boundary once
count + delta <= buckets so far, so an item without an entry has occurred at most that often. A task's summary holds at
most width * log(rows / width) entries beside those of the current chunk. Summaries merge by adding counts and
bounds; for an item that a task has no entry of, that task's bucket number is added. The true count then lies in
[count_lo, count_hi] and count_hi - count_lo <= eps * rows.

Items with a null part are no items but count as rows. Repeated rows count as they stand, ties all appear, an empty
table gives no rows, and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from strandforge.session import materialised

CHUNK = 1 << 16


def _summarise(item: list[str], types: pa.Schema, width: int):
    """Arrow batches of the item columns -> one summary. A row with null items has the task's bound and its rows."""
    names = [f.name for f in types]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = types.empty_table()
        rows, waiting, n_waiting = 0, [], 0

        def fold(held: pa.Table, parts: list[pa.RecordBatch], before: int, after: int) -> pa.Table:
            t = pa.Table.from_batches(parts).filter(pc.invert(pc.is_null(parts_any_null(parts))))
            new = t.group_by(item).aggregate([([], "count_all")]).rename_columns({"count_all": "count"})
            new = new.append_column("delta", pa.array([before] * len(new), pa.int64())).select(names).cast(types)
            both = pa.concat_tables([held, new]).group_by(item).aggregate([("count", "sum"), ("delta", "min")])
            both = both.rename_columns({"count_sum": "count", "delta_min": "delta"}).select(names)
            return both.filter(pc.greater(pc.add(both["count"], both["delta"]), after))

        def parts_any_null(parts: list[pa.RecordBatch]) -> pa.ChunkedArray:
            # null where any item column is null
            t = pa.Table.from_batches(parts)
            ok = pc.is_valid(t[item[0]])
            for c in item[1:]:
                ok = pc.and_(ok, pc.is_valid(t[c]))
            return pc.if_else(ok, True, pa.scalar(None, pa.bool_()))

        for batch in batches:
            waiting.append(batch.select(item))
            n_waiting += batch.num_rows
            if n_waiting >= CHUNK:
                before = rows // width
                rows += n_waiting
                held, waiting, n_waiting = fold(held, waiting, before, rows // width), [], 0
        if n_waiting:
            before = rows // width
            rows += n_waiting
            held = fold(held, waiting, before, rows // width)
        bound = rows // width
        last = pa.table({n: pa.array([None], types.field(n).type) for n in item} | {"count": [rows], "delta": [bound]}, schema=types)
        # an entry's slack is what it adds to the sum of all tasks' bounds
        held = held.set_column(len(names) - 1, "delta", pc.subtract(held["delta"], bound))
        yield from held.to_batches(max_chunksize=10_000)
        yield from last.to_batches()

    return run


def lossy_counts(df: DataFrame, item: list[str], width: int = 4000) -> tuple[DataFrame, int]:
    """Merged summary of ``df``: (item..., count_lo, count_hi), and the number of all rows.

    ``width`` is 1 / eps. An item with more than rows / width occurrences is never missing.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = df.select(*item).schema
    types = to_arrow_schema(fields).append(pa.field("count", pa.int64())).append(pa.field("delta", pa.int64()))
    types = pa.schema([pa.field(f.name, f.type) for f in types])
    out = fields.add("count", LongType()).add("delta", LongType())
    for f in out.fields:
        f.nullable = True
    parts = materialised(df.select(*item).mapInArrow(_summarise(item, types, width), out), "p6-parts")
    no_item = F.lit(True)
    for c in item:
        no_item = no_item & F.col(c).isNull()
    totals = parts.filter(no_item).agg(F.sum("count"), F.sum("delta")).first()
    rows, bound = int(totals[0] or 0), int(totals[1] or 0)
    merged = parts.filter(~no_item).groupBy(*item).agg(F.sum("count").alias("count_lo"), F.sum("delta").alias("__slack"))
    return merged.select(*item, "count_lo", (F.col("count_lo") + F.col("__slack") + F.lit(bound)).cast("bigint").alias("count_hi")), rows


def frequent(df: DataFrame, item: list[str], one_in: int = 400, width: int = 4000) -> DataFrame:
    """Items that may hold at least 1/``one_in`` of all rows, with their count intervals.

    None that does is missing; each has at least 1/one_in - 1/width of the rows, so there are fewer than
    1 / (1/one_in - 1/width) of them whatever the data.
    """
    if width <= one_in:
        raise ValueError("width must exceed one_in")
    counts, rows = lossy_counts(df, item, width)
    return counts.filter((F.col("count_hi") * one_in >= F.lit(rows)) & F.lit(rows > 0))


def frequent_exact(df: DataFrame, item: list[str], one_in: int = 400, width: int = 4000) -> DataFrame:
    """Items that hold at least 1/``one_in`` of all rows, exactly, with ``n_rows``: the candidates counted again.

    The candidates' number is bounded (see ``frequent``), so they are broadcast.
    """
    total = df.count()
    few = frequent(df, item, one_in, width).select(*[F.col(c).alias(f"__c_{c}") for c in item])
    on = F.lit(True)
    for c in item:
        on = on & (F.col(c) == F.col(f"__c_{c}"))
    counted = df.select(*item).join(F.broadcast(few), on, "left_semi").groupBy(*item).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.filter(F.col("n_rows") * one_in >= F.lit(total))


def intervals(df: DataFrame, item: list[str], one_in: int = 400, width: int = 4000) -> DataFrame:
    """The exact frequent items beside the summary's intervals: (item..., n_rows, inside), ``inside`` being that the summary has the item
    with count_lo <= n_rows <= count_hi and an interval of at most rows / width."""
    counts, rows = lossy_counts(df, item, width)
    few = counts.select(*[F.col(c).alias(f"__c_{c}") for c in item], "count_lo", "count_hi")
    exact = frequent_exact(df, item, one_in, width)
    on = F.lit(True)
    for c in item:
        on = on & (F.col(c) == F.col(f"__c_{c}"))
    inside = (F.col("count_lo") <= F.col("n_rows")) & (F.col("n_rows") <= F.col("count_hi")) & ((F.col("count_hi") - F.col("count_lo")) * width <= F.lit(rows))
    return exact.join(few, on, "left").select(*item, "n_rows", F.coalesce(inside, F.lit(False)).alias("inside"))
