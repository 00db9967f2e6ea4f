"""Has this key been seen before? (problem 1)

Keys are hashed to fingerprints of ``p`` bits. The high bits of a fingerprint name its shard; each shard keeps the
fingerprints of all earlier arrivals in packed quotient filters and nothing else. The stream is taken in batches, one an arrival
day: a batch is reduced to its distinct fingerprints before the shuffle (so a key that holds a third of the rows costs
a row a batch and map task), sorted by Spark by shard, day and fingerprint, and streamed past the shard's filters: what they don't
hold is a first sighting and goes into the day's own filter, which joins the cascade when the day ends. Known keys come in as
filters that ``build_filters`` made, so those of a stream's past needn't be read again as keys.

A filter never forgets, so an old key is never called new; a new key is called old when another key has its fingerprint, which
happens with a probability of about n / 2**p for n earlier keys. The fingerprints that two different keys share are found
by an independent second hash in one partial aggregate over the keys, and only their rows are compared by key in the end.

Memory of a task: the filters of one shard (a slot takes ceil(r / 8) bytes and 3 bits, some 4 to 8 bytes a key), the new keys of
one day in one shard (8 bytes each), and a batch. Shards are sized by the stream and the known keys together.

Keys are pairs (k, data). Rows whose ``data`` or ``k`` is null hold no key and are never "seen". A row whose ``arrived_at`` or
``obs_id`` is null has no place in the order: it makes no other row seen and is seen only if its key is known beforehand.
Ties in ``arrived_at`` are broken by ``obs_id``; of repeated rows with equal ``arrived_at`` and ``obs_id`` none precedes
the other. Days before 1970 or 1900 are days like others. Extra columns are ignored; an empty stream gives no rows, an empty list
of known keys is no list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandforge.llm.quotient import Builder, Cascade, QuotientFilter, expected_wrong
from strandforge.session import materialised

#: Keys that a shard is meant for; its filters then take some 10 MB.
SHARD_ROWS = 2_000_000
#: Shards at least, so that a small cluster's tasks have about equally many.
LEAST_BITS = 5
P_BITS = 48
#: (arrived_at, obs_id) as one number: microseconds times STEP, plus obs_id made non-negative by BIAS.
_BIAS = "cast('9223372036854775808' as decimal(20,0))"
_STEP = "cast('20000000000000000000' as decimal(20,0))"


def fingerprint(p: int) -> Column:
    """The first ``p`` bits of a 64-bit hash of the key, as a non-negative BIGINT (p < 64)."""
    return F.shiftrightunsigned(F.xxhash64("k", "data"), 64 - p)


def _other_hash() -> Column:
    return F.xxhash64(F.lit("second"), "data", "k")


def _order() -> Column:
    """(arrived_at, obs_id) as one number that a hash aggregate can take the minimum of."""
    at = F.unix_micros(F.col("arrived_at").cast("timestamp")).cast("decimal(19,0)")
    return (at * F.expr(_STEP)).cast("decimal(38,0)") + (F.col("obs_id").cast("decimal(20,0)") + F.expr(_BIAS))


def _row_of(order: str) -> Column:
    """The obs_id in a place in the order; 0 for null."""
    return F.coalesce((F.pmod(F.col(order), F.expr(_STEP)) - F.expr(_BIAS)).cast("bigint"), F.lit(0).cast("bigint"))


def shards_for(rows: int) -> int:
    """Shard bits: a power of two of shards, each of at most about SHARD_ROWS keys, at least 2**LEAST_BITS."""
    return max(LEAST_BITS, int(np.ceil(np.log2(max(1, rows) / SHARD_ROWS))))


def keyed(stream: DataFrame, p: int) -> DataFrame:
    """The rows that hold a key, with fingerprint, second hash and place in the order."""
    return (
        _valid(stream)
        .select("obs_id", "k", "data", "arrived_at")
        .withColumns({"__fp": fingerprint(p), "__h": _other_hash()})
    )


def _valid(df: DataFrame) -> DataFrame:
    return df.filter(F.col("data").isNotNull() & F.col("k").isNotNull())


def _placed() -> Column:
    return F.col("arrived_at").isNotNull() & F.col("obs_id").isNotNull()


def _bits(p: int, rows: int) -> int:
    return max(0, min(p - 8, shards_for(rows)))


def _tasks(df: DataFrame, bits: int) -> int:
    """Tasks for 2**bits shards: those of any shuffle, and more where a task would hold more than four shards."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // 4)


def _probe(p: int):
    """Rows sorted by (shard, day, fp), ``fp`` without the shard's bits -> first sightings (day, obs_id).

    Rows with a filter (a null day, so they come first) fill the shard's cascade; all others are different fingerprints of a day.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, Cascade(p)
        for batch in batches:
            shard = batch.column("shard").to_numpy(zero_copy_only=False)
            known = batch.column("filter").is_valid().to_numpy(zero_copy_only=False)
            day = batch.column("day").fill_null(0).to_numpy(zero_copy_only=False)
            fp = batch.column("fp").fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            rows = batch.column("obs_id")
            cuts = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (day[1:] != day[:-1]) | (known[1:] != known[:-1]))) if len(shard) else []
            fresh = np.zeros(len(shard), bool)
            for a, b in zip(cuts, [*cuts[1:], len(shard)]):
                here = (int(shard[a]), None if known[a] else int(day[a]))
                if at is not None and here != at:
                    held.close_day()
                if at is None or here[0] != at[0]:
                    held = Cascade(p)
                at = here
                if known[a]:
                    for raw in batch.column("filter").slice(a, b - a):
                        held.absorb(QuotientFilter.from_bytes(raw.as_py()))
                else:
                    fresh[a:b] = held.fresh(fp[a:b])
            keep = pa.array(fresh)
            yield pa.RecordBatch.from_arrays([batch.column("day").filter(keep), rows.filter(keep)], names=["day", "obs_id"])

    return run


def scan_stream(stream: DataFrame, known: DataFrame, p: int = P_BITS, rows: int | None = None) -> DataFrame:
    """The filters' pass over the stream: (day, obs_id) of every row whose fingerprint no earlier row and no known key has.

    ``day`` counts from 1970-01-01. Of a day's rows with one fingerprint the first by (arrived_at, obs_id) stands for all.
    ``rows``, the number of rows and known keys, is counted where it isn't given.
    """
    bits = _bits(p, stream.count() + known.count() if rows is None else rows)
    day = F.datediff(F.to_date("arrived_at"), F.lit("1970-01-01").cast("date"))
    batches = keyed(stream, p).filter(_placed()).groupBy(F.col("__fp").alias("fp"), day.alias("day")).agg(F.min(_order()).alias("first"))
    none = F.lit(None).cast("binary")
    new = batches.select(F.shiftright("fp", p - bits).cast("int").alias("shard"), "day", F.col("fp").bitwiseAND((1 << (p - bits)) - 1).alias("fp"), _row_of("first").alias("obs_id"), none.alias("filter"))
    null = F.lit(None)
    old = build_filters(known, p, bits).select("shard", null.cast("int").alias("day"), null.cast("bigint").alias("fp"), null.cast("bigint").alias("obs_id"), "filter")
    both = new.unionByName(old).repartition(_tasks(stream, bits), "shard").sortWithinPartitions("shard", F.col("day").asc_nulls_first(), "fp")
    return both.mapInArrow(_probe(p - bits), "day int, obs_id bigint")


def shared_fingerprints(stream: DataFrame, known: DataFrame, p: int = P_BITS) -> DataFrame:
    """(__fp): the fingerprints that at least two different keys have, told apart by the second hash."""
    rows = keyed(stream, p).select("__fp", "__h").unionByName(_valid(known).select(fingerprint(p).alias("__fp"), _other_hash().alias("__h")))
    return rows.groupBy("__fp").agg(F.min("__h").alias("lo"), F.max("__h").alias("hi")).filter("lo <> hi").select("__fp")


def seen_before(stream: DataFrame, known: DataFrame, p: int = P_BITS) -> DataFrame:
    """obs_id of every row whose key is known or came with an earlier row, exactly.

    The filters' pass names the first sightings; all other rows that hold a key are "maybe seen" (no false negatives). Of
    these, the rows of fingerprints that several keys share are checked by key, and wrongly taken ones are dropped.
    """
    firsts = materialised(scan_stream(stream, known, p).select("obs_id"), "p1-scan")
    shared = materialised(shared_fingerprints(stream, known, p), "p1-shared")
    keys = keyed(stream, p)
    maybe = keys.filter(_placed()).select("obs_id").join(firsts, "obs_id", "left_anti")

    # the exact check, for shared fingerprints only
    doubtful = keys.filter(_placed()).join(shared, "__fp", "left_semi")
    true_first = doubtful.groupBy("k", "data").agg(F.min(_order()).alias("first"))
    known_keys = _valid(known).select("k", "data")
    true_first = true_first.join(known_keys, ["k", "data"], "left_anti")
    wrong = true_first.select(_row_of("first").alias("obs_id"))
    maybe = maybe.join(wrong, "obs_id", "left_anti")
    unplaced = keys.filter(~_placed()).join(known_keys, ["k", "data"], "left_semi").select("obs_id")
    return maybe.unionByName(unplaced)


def first_sightings(stream: DataFrame, known: DataFrame, p: int = P_BITS) -> DataFrame:
    """Per ``ref_name`` (null is a group of its own) the rows that hold the first sighting of a key: ``first_n``.

    It counts keys where they first appear; names without a first sighting have no row.
    """
    new = _valid(stream).filter(_placed()).select("obs_id", "ref_name").join(seen_before(stream, known, p), "obs_id", "left_anti")
    return new.groupBy("ref_name").agg(F.count(F.lit(1)).alias("first_n"))


def error_rates(stream: DataFrame, known: DataFrame, bits: tuple[int, ...] = (28, 32, 48)) -> DataFrame:
    """Per fingerprint length the new keys, how many of them the filter takes for old ones, and the rate that theory gives.

    Columns: p_bits, new_keys, wrong, measured_rate, derived_rate, as_derived; the last says whether ``wrong`` lies within five
    standard deviations (and two keys) of what theory expects. Old keys are never taken for new ones.
    """
    spark = stream.sparkSession
    exact = _valid(stream).filter(_placed())
    known_keys = materialised(_valid(known).select("k", "data").distinct(), "p1-known")
    new_keys = exact.select("k", "data").distinct().join(known_keys, ["k", "data"], "left_anti").count()
    n_known, rows = known_keys.count(), stream.count() + known.count()
    out = []
    for p in bits:
        wrong = new_keys - scan_stream(stream, known, p, rows).count()
        want = expected_wrong(new_keys, n_known, p)
        each = max(1, new_keys)
        out.append((p, new_keys, wrong, wrong / each, want / each, abs(wrong - want) <= 5 * want**0.5 + 2))
    return spark.createDataFrame(out, "p_bits int, new_keys bigint, wrong bigint, measured_rate double, derived_rate double, as_derived boolean")


def _build(p: int):
    """Sorted (shard, fp) of different fingerprints -> a filter a shard, built while they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, n = None, [], 0

        def row() -> pa.RecordBatch:
            b = Builder(p, n)
            for x in parts:
                b.append(x)
            f = b.finish()
            return pa.RecordBatch.from_pydict({"shard": pa.array([at], pa.int32()), "n_keys": pa.array([f.n], pa.int64()), "filter": pa.array([f.to_bytes()], pa.binary())})

        for batch in batches:
            shard = batch.column("shard").to_numpy(zero_copy_only=False)
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
            for a, b in zip(cuts, [*cuts[1:], len(shard)]):
                if at is not None and shard[a] != at:
                    yield row()
                    parts, n = [], 0
                at, n = int(shard[a]), n + int(b - a)
                parts.append(fp[a:b].copy())
        if at is not None:
            yield row()

    return run


def build_filters(keys: DataFrame, p: int = P_BITS, bits: int | None = None) -> DataFrame:
    """Filters of a set of keys, one a shard: (shard, n_keys, filter). Filters of several days merge with merge_filters.

    A filter holds the fingerprints of its shard without the ``bits`` that name it, sorted by Spark before they are packed. Keys
    with a null are left out; no keys give no filter.
    """
    bits = _bits(p, keys.count()) if bits is None else bits
    fps = _valid(keys).select(fingerprint(p).alias("fp")).distinct()
    fps = fps.select(F.shiftright("fp", p - bits).cast("int").alias("shard"), F.col("fp").bitwiseAND((1 << (p - bits)) - 1).alias("fp"))
    return fps.repartition(_tasks(keys, bits), "shard").sortWithinPartitions("shard", "fp").mapInArrow(_build(p - bits), "shard int, n_keys bigint, filter binary")


def merge_filters(filters: DataFrame) -> DataFrame:
    """One filter a shard from any number of them, merged one after the other in a sorted stream."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"shard": pa.array([at], pa.int32()), "n_keys": pa.array([held.n], pa.int64()), "filter": pa.array([held.to_bytes()], pa.binary())})

        for batch in batches:
            for shard, raw in zip(batch.column("shard").to_pylist(), batch.column("filter")):
                f = QuotientFilter.from_bytes(raw.as_py())
                if held is not None and shard != at:
                    yield row()
                    held = None
                at, held = shard, f if held is None else held.merge(f)
        if held is not None:
            yield row()

    return filters.select("shard", "filter").repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, "shard int, n_keys bigint, filter binary")


def stored_keys(stream: DataFrame, known: DataFrame, p: int = P_BITS) -> DataFrame:
    """What the filters hold in the end: (kind, n_keys), kind ``known`` for the filters of the known keys, ``stream`` for those of
    the stream's placed rows, ``merged`` for both merged shard by shard. Filters are written once and merged from what was written."""
    bits = _bits(p, stream.count() + known.count())
    own = build_filters(stream.filter(_placed()), p, bits).withColumn("kind", F.lit("stream"))
    both = materialised(build_filters(known, p, bits).withColumn("kind", F.lit("known")).unionByName(own), "p1-filters")
    every = both.select("kind", "n_keys").unionByName(merge_filters(both).select(F.lit("merged").alias("kind"), "n_keys"))
    kinds = stream.sparkSession.createDataFrame([("known",), ("stream",), ("merged",)], "kind string")
    sums = every.groupBy("kind").agg(F.sum("n_keys").alias("n"))
    return kinds.join(F.broadcast(sums), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_keys"))  # three rows


def new_keys_by_day(stream: DataFrame, known: DataFrame, p: int = P_BITS) -> DataFrame:
    """(day, n_new): keys that the filters of all earlier days and of the known keys don't hold, per arrival day."""
    per = scan_stream(stream, known, p).groupBy("day").agg(F.count(F.lit(1)).alias("n_new"))
    return per.select(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias("day"), "n_new")
