"""Near-duplicate sequences (problem 7): fast similarity sketching, banding, exact verification.

A record is the set of its distinct 12-letter substrings that hold only A, C, G and T (case ignored); similar means a Jaccard
similarity of at least 0.6.

1. Exact copies (equal text, case ignored) become one class with the smallest id as its representative; only
   representatives go on.
2. Fast similarity sketching: in round i every element falls into one of T bins with the value (i, hash), and a bin keeps
   its smallest value, so later rounds only fill bins that are still empty; from round T on every element falls into bin i - T,
   so every bin of a non-empty set gets filled. A set of 130 elements needs two or three rounds instead of T hashes an
   element. Two sets agree in a bin with a probability of their similarity, with better concentration than independent minima.
3. Banding: three neighbouring bins make a band, 60 bands; records that share a band are candidates. A pair of similarity
   0.6 shares none with a probability of (1 - 0.216)**60 = 4.6e-7, one of 0.7 with 1.1e-11. Bands of two bins would let
   through several times as many unlike pairs, mostly records that share a tail, and their number grows as the square of the input.
4. Verification: each candidate pair's sets are compared exactly.

Copies are expanded only for p7_found, whose rows are pairs of records. Records without a valid substring are in no pair. Null or empty
sequences and null ids give nothing; repeated names or other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandforge.llm import dna, graph
from strandforge.llm.encode import text_chunks
from strandforge.session import materialised

K = 12
BINS = 180
ROWS = 3
SEED_AT = 54
THRESHOLD = (3, 5)  # 0.6 as a fraction
CHUNK = 2_000_000
_EMPTY = np.uint64(2**64 - 1)


def sketches(element: np.ndarray, owner: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """An (n, bins) array of the sets given by (owner, element) rows; rows of empty sets stay at the largest value."""
    out = np.full((n, bins), _EMPTY)
    # the sets with open bins, renumbered when a quarter of them is full; empty sets never take part
    rows = np.flatnonzero(np.bincount(owner, minlength=n))
    number = np.zeros(n, np.int64)
    number[rows] = np.arange(len(rows))
    owner, part = number[owner], np.full((len(rows), bins), _EMPTY)
    for i in range(2 * bins):
        h = dna.mixed(element, i)
        # a number below bins from the upper half of the hash
        place = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32) if i < bins else np.full(len(h), i - bins, np.uint64)
        value = (np.uint64(i) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        np.minimum.at(part.reshape(-1), owner * bins + place.astype(np.int64), value)
        open_ = (part == _EMPTY).any(axis=1)
        if not open_.any():
            break
        if open_.mean() < 0.75:
            out[rows[~open_]] = part[~open_]
            number = np.cumsum(open_) - 1
            left = open_[owner]
            element, owner, rows, part = element[left], number[owner[left]], rows[open_], part[open_]
    out[rows] = part
    return out


def band_keys(texts: list[str], seed: np.ndarray, bins: int = BINS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, key) of every band of every text with a non-empty set.

    Keys have the band in the upper 6 bits, ``seed`` (a number below 16 per text) in the next 4 and a hash in 38 more. The lower 16
    are 0: they follow the zeros at the head of a shuffled row and so cost nothing there; keys that are equal by chance give
    candidates that the verification drops.
    """
    buf, owner = dna.codes(texts)
    code, ok = dna.packed(buf, K)
    at = np.flatnonzero(ok)
    sk = sketches(code[at], owner[at].astype(np.int64), len(texts), bins)
    some = np.flatnonzero(sk[:, 0] != _EMPTY)
    sk = sk[some]
    keys = []
    for band in range(bins // rows):
        h = dna.mixed(seed[some].astype(np.uint64), band)
        place = (np.uint64(band) << np.uint64(58)) | (seed[some].astype(np.uint64) << np.uint64(SEED_AT))
        for j in range(rows):
            h = dna.mixed(h ^ sk[:, band * rows + j], j)
        keys.append(place | ((h >> np.uint64(26)) << np.uint64(16)))
    return np.tile(some, len(keys)), np.concatenate(keys).view(np.int64) if len(some) else np.zeros(0, np.int64)


def _records(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, id, seq, h1, h2) of all tables; the two hashes of the upper-cased text stand for it."""
    parts = []
    for i, df in enumerate(tables.values()):
        seq = F.translate("sequence", "acgt", "ACGT")
        d = df.filter(F.col("id").isNotNull() & (F.length("sequence") >= K)).select(F.lit(i).alias("tbl"), F.col("id").cast("bigint").alias("id"), seq.alias("seq"))
        parts.append(d)
    both = parts[0]
    for d in parts[1:]:
        both = both.unionByName(d)
    return both.withColumns({"h1": F.xxhash64("seq"), "h2": F.xxhash64(F.lit(1), "seq")})


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tbl, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tbl", "id"))
        for a, b, texts in text_chunks(batch, "seq", CHUNK):
            who, keys = band_keys(texts, tbl[a:b])
            for i in range(0, len(who), 100_000):
                part = who[i : i + 100_000] + a
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000]), pa.array(ids[part])], names=["key", "id"])


def _set_sizes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number << 24 | code), distinct and sorted, and the number of each text's codes."""
    buf, owner = dna.codes(texts)
    code, ok = dna.packed(buf, K)
    at = np.flatnonzero(ok)
    keys = np.sort((owner[at].astype(np.int64) << 2 * K) | code[at].astype(np.int64))
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    return keys, np.bincount(keys >> 2 * K, minlength=len(texts))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    num, den = THRESHOLD
    for batch in batches:
        for a, b, left in text_chunks(batch, "seq_a", CHUNK // 2):
            right = batch.column("seq_b").slice(a, b - a).to_pylist()
            (ka, na), (kb, nb) = _set_sizes(left), _set_sizes(right)
            both = np.sort(np.concatenate([ka, kb]), kind="stable")
            common = np.bincount(both[1:][both[1:] == both[:-1]] >> 2 * K, minlength=len(left))
            union = na + nb - common
            ok = pa.array((union > 0) & (common * den >= union * num))
            yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a).filter(ok) for c in ("tbl", "id_a", "id_b")] + [pa.array(common / np.maximum(union, 1)).filter(ok)], names=["tbl", "id_a", "id_b", "similarity"])


def classes(records: DataFrame) -> DataFrame:
    """(tbl, id, rep) of the records that have copies; rep is the smallest id of equal texts."""
    groups = records.groupBy("tbl", "h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep <> last").drop("last")
    # a group's row meets all its copies; the larger side is split where one group is hot (AQE)
    return records.select("tbl", "id", "h1", "h2").join(groups, ["tbl", "h1", "h2"]).select("tbl", "id", "rep").distinct()


#: Band rows that one task sorts: some 10 MB.
TASK_ROWS = 750_000


def band_tasks(records: DataFrame) -> int:
    """Tasks for the band rows: BINS / ROWS rows a record, TASK_ROWS a task, and at least those of any shuffle."""
    least = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-records.count() * (BINS // ROWS) // TASK_ROWS))


def similar_pairs(records: DataFrame, copies: DataFrame) -> DataFrame:
    """(tbl, id_a, id_b, similarity) of all similar pairs of representatives, id_a < id_b."""
    extra = copies.filter("id <> rep").select("tbl", "id")
    reps = records.select("tbl", "id", "seq").join(extra, ["tbl", "id"], "left_anti")
    bands = reps.mapInArrow(_band_rows, "key bigint, id bigint").repartition(band_tasks(records), "key")
    near = Window.partitionBy("key").orderBy("id")
    shared = bands.withColumn("n", F.coalesce(F.lag("id").over(near), F.lead("id").over(near))).filter(F.col("n").isNotNull()).drop("n")
    shared = materialised(shared, "p7-bands")
    a, b = shared.alias("a"), shared.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id"))).select(F.shiftrightunsigned("a.key", SEED_AT).bitwiseAND(F.lit(15)).cast("int").alias("tbl"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
    met = materialised(met.distinct(), "p7-candidates")
    needed = met.select("tbl", F.col("id_a").alias("id")).unionByName(met.select("tbl", F.col("id_b").alias("id"))).distinct()
    texts = materialised(records.select("tbl", "id", "seq").join(needed, ["tbl", "id"], "left_semi"), "p7-texts")
    pairs = met.join(texts.select("tbl", F.col("id").alias("id_a"), F.col("seq").alias("seq_a")), ["tbl", "id_a"])
    pairs = pairs.join(texts.select("tbl", F.col("id").alias("id_b"), F.col("seq").alias("seq_b")), ["tbl", "id_b"])
    return pairs.select("tbl", "id_a", "id_b", "seq_a", "seq_b").mapInArrow(_verify, "tbl int, id_a bigint, id_b bigint, similarity double")


def _name(tables: dict[str, DataFrame]) -> Column:
    names = list(tables)
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col("tbl") + 1)


def _valid_copies(records: DataFrame, copies: DataFrame) -> DataFrame:
    """Copies whose text has a valid substring, so that they are similar to each other."""
    good = records.filter(F.col("seq").rlike(f"[ACGT]{{{K}}}")).select("tbl", "id")
    return copies.join(good, ["tbl", "id"], "left_semi")


def found(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, id_a, id_b) of all similar pairs of records of one table, id_a < id_b."""
    records = _records(tables)
    copies = materialised(_valid_copies(records, classes(records)), "p7-copies")
    pairs = similar_pairs(records, copies).select("tbl", "id_a", "id_b")
    for side in ("id_a", "id_b"):
        c = copies.select("tbl", F.col("rep").alias(side), F.col("id").alias("m"))
        pairs = pairs.join(c, ["tbl", side], "left").withColumn(side, F.coalesce("m", side)).drop("m")
    pairs = pairs.select("tbl", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    x, y = copies.alias("x"), copies.alias("y")
    same = x.join(y, (F.col("x.tbl") == F.col("y.tbl")) & (F.col("x.rep") == F.col("y.rep")) & (F.col("x.id") < F.col("y.id")))
    same = same.select("x.tbl", F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
    return pairs.unionByName(same).select(_name(tables).alias("table_name"), "id_a", "id_b")


def groups(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, id, group_id, n_links) of every record: group_id is the smallest id of its group of linked records, n_links its
    similar records, copies included. Records without a link are groups of their own with 0 links."""
    records = _records(tables)
    copies = materialised(_valid_copies(records, classes(records)), "p7-copies")
    pairs = materialised(similar_pairs(records, copies).select("tbl", "id_a", "id_b"), "p7-pairs")
    # nodes of both tables in one graph: the table's number is the lowest digit
    node = lambda c: F.col(c) * len(tables) + F.col("tbl")
    roots = graph.components(pairs.select(node("id_a").alias("a"), node("id_b").alias("b")), "a", "b")
    size = copies.groupBy("tbl", "rep").agg(F.count(F.lit(1)).alias("n"))
    ends = pairs.select("tbl", F.col("id_a").alias("rep"), F.col("id_b").alias("other")).unionByName(pairs.select("tbl", F.col("id_b").alias("rep"), F.col("id_a").alias("other")))
    links = ends.join(size.withColumnRenamed("rep", "other"), ["tbl", "other"], "left").groupBy("tbl", "rep").agg(F.sum(F.coalesce("n", F.lit(1))).alias("links"))
    every = None
    for i, df in enumerate(tables.values()):
        d = df.filter(F.col("id").isNotNull()).select(F.lit(i).alias("tbl"), F.col("id").cast("bigint").alias("id"))
        every = d if every is None else every.unionByName(d)
    got = every.join(copies, ["tbl", "id"], "left").withColumn("rep", F.coalesce("rep", "id"))
    got = got.join(size, ["tbl", "rep"], "left").join(links, ["tbl", "rep"], "left")
    got = got.withColumn("node", node("rep")).join(roots, "node", "left")
    return got.select(
        _name(tables).alias("table_name"),
        "id",
        F.coalesce(F.floor((F.col("root") - F.col("tbl")) / len(tables)), F.col("rep")).cast("bigint").alias("group_id"),
        (F.coalesce("n", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("bigint").alias("n_links"),
    )
