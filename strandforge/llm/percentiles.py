"""Percentiles with bounded rank error (problem 5), by randomized compactor hierarchies.

A sketch is a list of levels; an item of level i stands for 2**i values. A level that outgrows its capacity is sorted
and every other item of it, from a random start, moves up a level. Capacities shrink by 2/3 a level below the top.
Sketches merge level by level and compact again. Levels are kept as runs (value, count): a level is full when it has
too many *different* values, so columns with few values, like Phred scores, stay exact.

With K = 1024 a sketch holds at most about 3 K runs, and the rank error of one percentile is below 0.5 % with a
probability of more than 99.99 % (standard deviation about 0.6 / K of the number of values), however the values were
spread over partitions and days. The random starts come from a counter-based generator, so a task that runs again gives
the same sketch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandforge.session import materialised

K = 1024
#: Runs that a task holds before it passes its sketches on.
TASK_RUNS = 2_000_000
#: Values or quality bytes that are taken up at once.
CHUNK = 8_000_000


def _coin(n: int, level: int) -> int:
    x = (n * 0x9E3779B97F4A7C15 + level * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return (x >> 40) & 1


def _runs(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different values and the sums of their counts."""
    order = np.argsort(values, kind="stable")
    v, c = values[order], counts[order]
    if len(v) < 2:
        return v, c
    start = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    return v[start], np.add.reduceat(c, start)


class Sketch:
    """``levels``: a list of (values, counts); ``n``: the number of values taken up."""

    def __init__(self, k: int = K):
        self.k, self.n, self.levels, self.flips = k, 0, [(np.zeros(0), np.zeros(0, np.int64))], 0

    def _capacity(self, level: int) -> int:
        return max(8, int(np.ceil(self.k * (2 / 3) ** (len(self.levels) - 1 - level))))

    def add(self, values: np.ndarray, counts: np.ndarray | None = None) -> None:
        """Take up values, each ``counts`` times."""
        counts = np.ones(len(values), np.int64) if counts is None else counts
        self.n += int(counts.sum())
        v, c = self.levels[0]
        self.levels[0] = _runs(np.concatenate([v, values]), np.concatenate([c, counts]))
        self._compact()

    def merge(self, other: Sketch) -> None:
        self.n += other.n
        self.flips += other.flips
        while len(self.levels) < len(other.levels):
            self.levels.append((np.zeros(0), np.zeros(0, np.int64)))
        for i, (v, c) in enumerate(other.levels):
            a, b = self.levels[i]
            self.levels[i] = _runs(np.concatenate([a, v]), np.concatenate([b, c])) if len(v) else (a, b)
        self._compact()

    def _compact(self) -> None:
        i = 0
        while i < len(self.levels):
            v, c = self.levels[i]
            if len(v) > self._capacity(i):
                if i + 1 == len(self.levels):
                    self.levels.append((np.zeros(0), np.zeros(0, np.int64)))
                self.flips += 1
                start = _coin(self.n * 64 + self.flips, i)
                end = np.cumsum(c)
                total = int(end[-1])
                even = total - total % 2  # an odd last item stays behind
                lo, hi = np.minimum(end - c, even), np.minimum(end, even)
                up = (hi - start + 1) // 2 - (lo - start + 1) // 2
                a, b = self.levels[i + 1]
                took = up > 0
                self.levels[i + 1] = _runs(np.concatenate([a, v[took]]), np.concatenate([b, up[took]]))
                self.levels[i] = (v[-1:], np.ones(1, np.int64)) if total % 2 else (v[:0], c[:0])
            i += 1

    @property
    def size(self) -> int:
        return sum(len(v) for v, _ in self.levels)

    def quantiles(self, qs: list[float]) -> list[float | None]:
        """For each q the smallest value whose share of values up to it is at least q, by the sketch."""
        if not self.n:
            return [None] * len(qs)
        v = np.concatenate([v for v, _ in self.levels])
        w = np.concatenate([c << i for i, (_, c) in enumerate(self.levels)])
        v, w = _runs(v, w)
        cum = np.cumsum(w)
        return [float(v[min(len(v) - 1, int(np.searchsorted(cum, q * cum[-1], side="left")))]) for q in qs]

    def to_bytes(self) -> bytes:
        head = np.array([self.k, self.n, self.flips, len(self.levels), *(len(v) for v, _ in self.levels)], "<i8").tobytes()
        return head + b"".join(v.astype("<f8").tobytes() + c.astype("<i8").tobytes() for v, c in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Sketch:
        k, n, flips, depth = (int(x) for x in np.frombuffer(raw, "<i8", 4))
        sizes, at = np.frombuffer(raw, "<i8", depth, 32), 32 + 8 * depth
        s = cls(k)
        s.n, s.flips, s.levels = n, flips, []
        for m in sizes:
            v = np.frombuffer(raw, "<f8", m, at)
            s.levels.append((v, np.frombuffer(raw, "<i8", m, at + 8 * int(m))))
            at += 16 * int(m)
        return s


_PARTIAL = "metric string, grp string, day date, n bigint, sketch binary"
_SCHEMA = pa.schema([("metric", pa.string()), ("grp", pa.string()), ("day", pa.date32()), ("n", pa.int64()), ("sketch", pa.binary())])


def _rows(held: dict) -> Iterator[pa.RecordBatch]:
    items = list(held.items())
    for i in range(0, len(items), 500):
        part = items[i : i + 500]
        columns = [[key[j] for key, _ in part] for j in range(3)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.date32()), pa.array([s.n for _, s in part], pa.int64()), pa.array([s.to_bytes() for _, s in part], pa.binary())],
            schema=_SCHEMA,
        )


def _take_up(metric: str, is_text: bool):
    """(grp, day, value) -> partial sketches of a task; ``value`` is a number, or Phred+33 text taken up letter by letter."""

    def histogram(t: pa.Table, code: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text = t["value"].combine_chunks()
        raw = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = np.frombuffer(text.buffers()[1], np.int64 if pa.types.is_large_string(text.type) else np.int32, len(text) + 1, text.offset * (8 if pa.types.is_large_string(text.type) else 4)).astype(np.int64)
        letters = raw[at[0] : at[-1]]
        full = np.bincount(np.repeat(code, np.diff(at)) * 256 + letters, minlength=n_groups * 256)
        seen = np.flatnonzero(full)
        return seen // 256, np.maximum(seen % 256 - 33, 0).astype(np.float64), full[seen]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}
        waiting: list[pa.RecordBatch] = []
        weight = 0

        def take() -> None:
            t = pa.Table.from_batches(waiting)
            t = t.filter(t["value"].is_valid())
            if not is_text and len(t):
                t = t.filter(pa.array(~np.isnan(t["value"].to_numpy())))
            if not len(t):
                return
            groups = t.select(["grp", "day"]).group_by(["grp", "day"]).aggregate([])
            keys = list(zip(groups["grp"].to_pylist(), groups["day"].to_pylist()))
            grp, day = (t[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in ("grp", "day"))
            pair = grp.indices.to_numpy().astype(np.int64) * (len(day.dictionary) + 1) + day.indices.to_numpy()
            used, code = np.unique(pair, return_inverse=True)
            gd, dd = grp.dictionary.to_pylist(), day.dictionary.to_pylist()
            keys = [(gd[p // (len(dd) + 1)], dd[p % (len(dd) + 1)]) for p in used]
            if is_text:
                owner, values, counts = histogram(t, code, len(used))
            else:
                values = t["value"].to_numpy().astype(np.float64)
                order = np.argsort(code, kind="stable")
                owner, values, counts = code[order], values[order], None
            cut = np.searchsorted(owner, np.arange(len(used) + 1))
            for i, key in enumerate(keys):
                a, b = cut[i], cut[i + 1]
                if a < b:
                    s = held.setdefault((metric, *key), Sketch())
                    s.add(values[a:b], None if counts is None else counts[a:b])

        for batch in batches:
            waiting.append(batch)
            weight += batch.column("value").nbytes if is_text else batch.num_rows * 8
            if weight >= CHUNK:
                take()
                waiting, weight = [], 0
                if sum(s.size for s in held.values()) > TASK_RUNS:
                    yield from _rows(held)
                    held = {}
        if waiting:
            take()
        yield from _rows(held)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches of equal (metric, grp, day) follow each other and become one."""
    done: dict[tuple, Sketch] = {}
    at, held = None, None
    for batch in batches:
        part = batch.column("__s").to_pylist() if "__s" in batch.schema.names else [0] * batch.num_rows
        for metric, grp, day, raw, no in zip(*(batch.column(c).to_pylist() for c in ("metric", "grp", "day", "sketch")), part):
            s = Sketch.from_bytes(raw)
            if held is not None and (metric, grp, day, no) == at:
                held.merge(s)
                continue
            if held is not None:
                done[at] = held
                if len(done) >= 500:
                    yield from _rows(done)
                    done = {}
            at, held = (metric, grp, day, no), s
    if held is not None:
        done[at] = held
    yield from _rows(done)


def partial_sketches(df: DataFrame, metric: str, grp: str, day, value: str) -> DataFrame:
    """Sketches of ``value`` per (grp, day), one or more a task, under the name ``metric``.

    Null values and NaN are left out; null groups and days are groups; empty texts add nothing. Only the three columns
    are read.
    """
    is_text = dict(df.dtypes)[value] == "string"
    rows = df.select(F.col(grp).cast("string").alias("grp"), day.cast("date").alias("day"), (F.col(value) if is_text else F.col(value).cast("double")).alias("value"))
    return rows.mapInArrow(_take_up(metric, is_text), _PARTIAL)


#: Partial sketches of one group that a task merges; of more, square roots of their number are merged first.
TOGETHER = 256


def merge_sketches(sketches: DataFrame, over_days: bool = False, together: int = TOGETHER) -> DataFrame:
    """One sketch per (metric, grp, day), or per (metric, grp) with a null day.

    A group can have a sketch from every task. Beyond ``together`` tasks the sketches are merged in two levels: those of some
    tasks each, then what came of them, so that no task merges all sketches of a group that holds most rows.
    """
    rows = sketches.withColumn("day", F.lit(None).cast("date")) if over_days else sketches
    keys = ["metric", "grp", "day"]
    tasks = rows.rdd.getNumPartitions()
    if tasks > together:
        some = [*keys, "__s"]
        first = rows.withColumn("__s", F.pmod(F.spark_partition_id(), F.lit(int(tasks**0.5))))
        rows = first.repartition(*some).sortWithinPartitions(*some).select("metric", "grp", "day", "n", "sketch", "__s").mapInArrow(_merge, _PARTIAL)
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merge, _PARTIAL)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        q = [Sketch.from_bytes(raw.as_py()).quantiles([0.5, 0.9, 0.99]) for raw in batch.column("sketch")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("metric", "grp", "day", "n")), *(pa.array([x[i] for x in q], pa.float64()) for i in range(3))],
            names=["metric", "grp", "day", "n", "p50", "p90", "p99"],
        )


def percentiles(reads: DataFrame, summaries: DataFrame, faidx: DataFrame) -> DataFrame:
    """50th, 90th and 99th percentiles: (metric, grp, day, span, n, p50, p90, p99).

    phred: single values of reads.quality per run and day; avg_len: of fq_summaries per platform and day; length: of
    faidx per file_name. span ``day`` has the daily results, span ``all`` those over all days, merged from the daily
    sketches (``length`` has no days and only the latter). Groups without any value have no row.
    """
    no_day = F.lit(None).cast("date")
    parts = partial_sketches(reads, "phred", "run", F.to_date("sequenced_at"), "quality")
    parts = parts.unionByName(partial_sketches(summaries, "avg_len", "platform", F.to_date("summarised_at"), "avg_len"))
    parts = parts.unionByName(partial_sketches(faidx, "length", "file_name", no_day, "length"))
    daily = materialised(merge_sketches(parts), "p5-daily")
    out = "metric string, grp string, day date, n bigint, p50 double, p90 double, p99 double"
    by_day = daily.filter("metric <> 'length'").mapInArrow(_answers, out).withColumn("span", F.lit("day"))
    over = merge_sketches(daily, over_days=True).mapInArrow(_answers, out).withColumn("span", F.lit("all"))
    return by_day.unionByName(over).select("metric", "grp", "day", "span", "n", "p50", "p90", "p99")


def _values(reads: DataFrame, summaries: DataFrame, faidx: DataFrame) -> DataFrame:
    """(metric, grp, day, x, n): every value of the three columns with its number of rows, counted exactly."""
    letters = F.filter(F.split("quality", ""), lambda c: c != "")
    one = reads.select(F.lit("phred").alias("metric"), F.col("run").alias("grp"), F.to_date("sequenced_at").alias("day"), F.explode(letters).alias("c"))
    phred = one.groupBy("metric", "grp", "day", "c").agg(F.count(F.lit(1)).alias("n")).withColumn("x", F.greatest(F.ascii("c") - 33, F.lit(0)).cast("double")).drop("c")
    avg = summaries.select(F.lit("avg_len").alias("metric"), F.col("platform").alias("grp"), F.to_date("summarised_at").alias("day"), F.col("avg_len").cast("double").alias("x"))
    size = faidx.select(F.lit("length").alias("metric"), F.col("file_name").alias("grp"), F.lit(None).cast("date").alias("day"), F.col("length").cast("double").alias("x"))
    rest = avg.unionByName(size).filter(F.col("x").isNotNull() & ~F.isnan("x")).groupBy("metric", "grp", "day", "x").agg(F.count(F.lit(1)).alias("n"))
    return phred.unionByName(rest)


def rank_errors(reads: DataFrame, summaries: DataFrame, faidx: DataFrame) -> DataFrame:
    """Exact ranks of the percentiles that ``percentiles`` reports: (metric, grp, day, span, n, within).

    ``n`` is the exact number of values; ``within`` says that each of the three percentiles has a rank, between the share of values
    below it and the share up to it, that is at most 1 % from what was asked for. A check: it counts all values.
    """
    values = materialised(_values(reads, summaries, faidx), "p5-values")
    got = percentiles(reads, summaries, faidx).withColumnsRenamed({"n": "__n", "grp": "__grp", "day": "__day", "metric": "__metric"})
    on = F.col("grp").eqNullSafe(F.col("__grp")) & (F.col("metric") == F.col("__metric")) & ((F.col("span") == "all") | F.col("day").eqNullSafe(F.col("__day")))
    both = values.join(got, on)
    aggs = [F.sum("n").alias("n"), F.max("__n").alias("__n")]
    for p in ("p50", "p90", "p99"):
        aggs += [F.coalesce(F.sum(F.when(F.col("x") < F.col(p), F.col("n"))), F.lit(0)).alias(f"{p}_lo"), F.coalesce(F.sum(F.when(F.col("x") <= F.col(p), F.col("n"))), F.lit(0)).alias(f"{p}_hi")]
    ranks = both.groupBy("__metric", "__grp", "__day", "span").agg(*aggs)
    ok = F.col("n") == F.col("__n")
    for p, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
        ok = ok & (F.col(f"{p}_lo") / F.col("n") <= q + 0.01) & (F.col(f"{p}_hi") / F.col("n") >= q - 0.01)
    return ranks.select(F.col("__metric").alias("metric"), F.col("__grp").alias("grp"), F.col("__day").alias("day"), "span", F.col("n").cast("bigint").alias("n"), ok.alias("within"))
