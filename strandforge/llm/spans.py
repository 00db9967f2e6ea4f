"""Long exact spans shared between records (problem 3), by winnowed anchors.

A span counts when it is at least SPAN letters long, holds only A, C, G and T (case ignored) and occurs in another record too,
on the same strand. Records of equal text (case ignored) are one class, of which only the record with the smallest id goes on; a
class's copies share all their spans with each other, so n copies cost one record.

Every window of SPAN letters has one anchor: the 32-mer in it with the smallest hash (the leftmost of
equal ones); 32-mers with a period of up to 6 come after all others, so tails and simple repeats anchor nothing else. Consecutive windows with
the same anchor make one fragment of at most 2 * SPAN - 32 letters, which travels with its anchor as 2-bit letters. The anchor of a
window depends on its letters only, so two records that share a window meet at its anchor, aligned: no text is fetched for
extending.

- ``shared`` (a row a record) never forms pairs: the windows of an anchor's fragments are sorted, and those that several classes hold are
  marked, which is linear in the windows.
- ``pairs`` and ``matches`` extend the fragments of one anchor both ways from the anchor and keep extensions of SPAN letters or more.
  ``pairs`` takes of each maximal repeat of two records only the piece where it begins (the letters before it differ), so it has
  one row a repeat however many anchors that has; ``matches`` has a piece an anchor, and ``repeats`` joins them.
- An anchor with more than HOT fragments isn't worked through by one task: its fragments are cut to their windows, which meet by
  their letters in a shuffle, spread over the cluster; only windows at which a repeat can begin are joined.

Records with a null id or a null or short sequence share nothing. Repeated rows are one record; rows that repeat an id with another text
are records of their own, but an id is never paired with itself. A record's own repeats don't count. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandforge.llm import dna
from strandforge.llm.encode import text_chunks
from strandforge.session import materialised

SPAN = 120
ANCHOR = 32
PERIOD = 6
HOT = 512
CHUNK = 1_000_000
PAIRS = 50_000
_PLACE = 24


def _anchors(buf: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Valid windows of ``span`` letters (their starts) and the place of each one's anchor."""
    kmer, ok = dna.packed(buf, ANCHOR)
    if len(buf) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = dna.mixed(kmer) >> np.uint64(_PLACE + 1)
    simple = np.zeros(len(kmer), bool)
    for p in range(1, PERIOD + 1):
        same = np.concatenate([[0], np.cumsum(buf[p:] == buf[:-p], dtype=np.int32)])
        simple |= (same[ANCHOR - p :] - same[: len(same) - ANCHOR + p])[: len(kmer)] == ANCHOR - p
    rank = np.where(simple, rank | np.uint64(1 << (63 - _PLACE)), rank)
    # rank in the high bits, place in the low ones: the smallest is the leftmost of the smallest rank
    low = (rank << np.uint64(_PLACE)) | np.arange(len(rank), dtype=np.uint64)
    width, size = span - ANCHOR + 1, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    bad = np.concatenate([[0], np.cumsum(buf == 4, dtype=np.int32)])
    starts = np.flatnonzero(bad[span:] == bad[:-span])
    return starts, (low[starts] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)


def fragments(texts: list[str], span: int = SPAN) -> tuple[np.ndarray, ...]:
    """All fragments of the texts: text number, anchor letters (int64), start in the text, anchor's offset, length, the letter before
    (4 for none or another than A, C, G and T), letters (rows)."""
    buf, owner = dna.codes(texts)
    if len(buf) >= 1 << _PLACE:
        raise ValueError("a batch of more than 16 million letters must be cut before")
    starts, anchor = _anchors(buf, span)
    if not len(starts):
        e = np.zeros(0, np.int64)
        return e, e, e, e, e, e, np.zeros((0, (2 * span - ANCHOR + 3) // 4), np.uint8)
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    start, end, at = starts[first], starts[last] + span, anchor[first]
    kmer, _ = dna.packed(buf, ANCHOR)
    room = (2 * span - ANCHOR + 3) // 4 * 4
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([buf & 3, np.zeros(room, np.uint8)]), room)
    letters = windows[start].reshape(len(start), -1, 4)
    letters = (letters[:, :, 0] << 6) | (letters[:, :, 1] << 4) | (letters[:, :, 2] << 2) | letters[:, :, 3]
    begin = np.searchsorted(owner, np.arange(len(texts)))
    who = owner[start].astype(np.int64)
    before = np.where(start > begin[who], buf[np.maximum(start - 1, 0)], 4).astype(np.int64)
    return who, kmer[at].view(np.int64), start - begin[who], at - start, end - start, before, letters


def _unpack(raw: list[bytes]) -> np.ndarray:
    packed = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
    return np.stack([(packed >> s) & 3 for s in (6, 4, 2, 0)], axis=2).reshape(len(raw), -1)


_FRAGMENT = "anchor bigint, cls bigint, id bigint, start bigint, at int, size int, prior int, letters binary"
_PARTS = ["anchor", "cls", "id", "start", "at", "size", "prior"]


def _cut(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cls = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "cls"))
            for a, b, texts in text_chunks(batch, "seq", CHUNK):
                for shift, part, own in _pieces(texts, span):
                    who, anchor, start, at, size, before, letters = fragments(part, span)
                    cut = (shift[who] > 0) & (start == 0)
                    before[cut] = [int(dna.CODE[min(255, ord(texts[own[w]][shift[w] - 1]))]) for w in who[cut]]
                    for i in range(0, len(who), 20_000):
                        s = slice(i, i + 20_000)
                        raw = pa.array([r.tobytes() for r in letters[s]], pa.binary())
                        row = a + own[who[s]]
                        columns = [anchor[s], cls[row], ids[row], start[s] + shift[who[s]], *(x[s].astype(np.int32) for x in (at, size, before))]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), raw], names=[*_PARTS, "letters"])

    return run


def _pieces(texts: list[str], span: int, most: int = 8_000_000) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """(start of each piece in its text, pieces, their text numbers); texts beyond ``most`` letters are cut with an overlap
    of span - 1, so that every window lies in one piece."""
    long = [i for i, t in enumerate(texts) if len(t) > most]
    rest = [i for i, t in enumerate(texts) if len(t) <= most]
    if rest:
        yield np.zeros(len(rest), np.int64), [texts[i] for i in rest], np.array(rest)
    for i in long:
        for a in range(0, len(texts[i]) - span + 1, most):
            yield np.array([a]), [texts[i][a : a + most + span - 1]], np.array([i])


_MATCH = "cls_a bigint, cls_b bigint, id_a bigint, id_b bigint, start_a bigint, start_b bigint, length bigint"
_NAMES = ["cls_a", "cls_b", "id_a", "id_b", "start_a", "start_b", "length"]


def _extended(letters: np.ndarray, x: np.ndarray, y: np.ndarray, at: np.ndarray, size: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of rows of equal anchors the letters that agree to the left of the anchor and to its right."""
    reach = span - ANCHOR
    column = np.arange(reach)

    def same(px: np.ndarray, py: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """Equal letters from (px, py) on in the direction ``step``, at most ``most``."""
        cx, cy = px[:, None] + step * column, py[:, None] + step * column
        inner = column < most[:, None]
        equal = letters[x[:, None], np.where(inner, cx, 0)] == letters[y[:, None], np.where(inner, cy, 0)]
        equal &= inner
        return np.where(equal.all(axis=1), reach, np.argmin(equal, axis=1))

    left = same(at[x] - 1, at[y] - 1, np.minimum(at[x], at[y]), -1)
    return left, same(at[x] + ANCHOR, at[y] + ANCHOR, np.minimum(size[x] - at[x], size[y] - at[y]) - ANCHOR, 1)


def _groups(t: pa.Table) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray], np.ndarray] | None:
    """Of rows sorted by anchor those of anchors with several rows: the groups' first rows and sizes, columns, letters."""
    c = {n: t[n].to_numpy().astype(np.int64) for n in _PARTS}
    head = np.flatnonzero(np.append(True, c["anchor"][1:] != c["anchor"][:-1]))
    count = np.diff(np.append(head, len(t)))
    place = np.flatnonzero(np.repeat(count > 1, count))
    if not len(place):
        return None
    count = count[count > 1]
    return np.cumsum(np.append(0, count[:-1])), count, {n: v[place] for n, v in c.items()}, _unpack(t["letters"].take(pa.array(place)).to_pylist())


def _compare(t: pa.Table, span: int, begins: bool) -> Iterator[pa.RecordBatch]:
    """Matches of span letters and more between fragments of equal anchors; with ``begins`` only those where a repeat begins."""
    got = _groups(t)
    if got is None:
        return
    head, count, c, letters = got
    cls, ids, start, at, size, prior = (c[n] for n in _PARTS[1:])
    # each row meets the later rows of its group
    inside = np.arange(len(ids)) - np.repeat(head, count)
    later = np.repeat(count, count) - 1 - inside
    total = np.cumsum(later)
    a = 0
    while a < len(ids):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, side="right")))
        x = np.repeat(np.arange(a, b), later[a:b])
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(later[a:b]) - later[a:b], later[a:b])
        other = cls[x] != cls[y]
        x, y = x[other], y[other]
        a = b
        if not len(x):
            continue
        left, right = _extended(letters, x, y, at, size, span)
        length = left + ANCHOR + right
        good = length >= span
        if begins:
            # it goes on in the fragments before these, where both begin with the repeat and the same letter comes before
            good &= ~((left == at[x]) & (left == at[y]) & (prior[x] < 4) & (prior[x] == prior[y]))
        yield _match_rows(cls, ids, start, at, x[good], y[good], left[good], length[good])


def _match_rows(cls: np.ndarray, ids: np.ndarray, start: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, left: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    swap = (ids[x] > ids[y]) | ((ids[x] == ids[y]) & (cls[x] > cls[y]))
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    return pa.RecordBatch.from_arrays([*map(pa.array, (cls[x], cls[y], ids[x], ids[y], start[x] + at[x] - left, start[y] + at[y] - left, length))], names=_NAMES)


def _window_keys(letters: np.ndarray, size: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, offset and hash of every window of the rows."""
    value = dna.mixed(np.arange(4, dtype=np.uint64), 7)
    base = np.uint64(0x9E3779B97F4A7C15)
    power = np.uint64(pow(0x9E3779B97F4A7C15, span, 2**64))
    prefix = np.zeros((letters.shape[1] + 1, len(letters)), np.uint64)
    for i in range(letters.shape[1]):
        prefix[i + 1] = prefix[i] * base + value[letters[:, i]]
    h = prefix[span:] - prefix[: len(prefix) - span] * power
    offset, row = np.nonzero(np.arange(h.shape[0])[:, None] <= size - span)
    return row, offset, dna.mixed(h[offset, row], 3)


def _mark_groups(group: np.ndarray, c: dict[str, np.ndarray], letters: np.ndarray, span: int) -> Iterator[pa.RecordBatch]:
    row, offset, h = _window_keys(letters, c["size"], span)
    # equal windows have their anchor at the same place
    key = dna.mixed(h ^ (group[row].astype(np.uint64) << np.uint64(40)), 11) ^ dna.mixed((offset - c["at"][row]).astype(np.uint64), 13)
    order = np.argsort(key, kind="stable")
    k, row, offset = key[order], row[order], offset[order]
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    cls = c["cls"][row]
    several = np.minimum.reduceat(cls, start) != np.maximum.reduceat(cls, start)
    many = np.diff(np.append(start, len(k)))
    keep = np.repeat(several, many)
    row, offset, k = row[keep], offset[keep], k[keep]
    if not len(row):
        return
    # the letters of neighbours with one hash are compared; should they differ, windows meet by their letters
    twin = np.flatnonzero(k[1:] == k[:-1])
    place = np.arange(span)
    equal = True
    for i in range(0, len(twin), 20_000):
        t = twin[i : i + 20_000]
        equal = equal and bool((letters[row[t][:, None], offset[t][:, None] + place] == letters[row[t + 1][:, None], offset[t + 1][:, None] + place]).all())
    if not equal:
        seen: dict[tuple, list[int]] = {}
        for i, (r, o) in enumerate(zip(row.tolist(), offset.tolist())):
            seen.setdefault((int(group[r]), letters[r, o : o + span].tobytes()), []).append(i)
        good = [i for at in seen.values() if len({int(c["cls"][row[i]]) for i in at}) > 1 for i in at]
        row, offset = row[good], offset[good]
    order = np.lexsort((offset, row))
    row, offset = row[order], offset[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)))
    last = np.append(first[1:], len(row)) - 1
    r = row[first]
    yield pa.RecordBatch.from_arrays([*map(pa.array, (c["cls"][r], c["id"][r], c["start"][r] + offset[first], c["start"][r] + offset[last] + span))], names=["cls", "id", "s", "e"])


def _mark(t: pa.Table, span: int, most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Stretches (cls, id, s, e) of fragments whose windows lie in fragments of another class with the same anchor too."""
    got = _groups(t)
    if got is None:
        return
    head, count, c, letters = got
    ends = head + count
    group = np.repeat(np.arange(len(head)), count)
    a = 0
    while a < len(head):
        b = max(a + 1, int(np.searchsorted(ends, head[a] + most, side="right")))
        s = slice(head[a], ends[b - 1])
        yield from _mark_groups(group[s], {n: v[s] for n, v in c.items()}, letters[s], span)
        a = b


def _by_anchor(work):
    """Rows sorted by anchor -> ``work`` on tables of whole anchors. A group of rows is at most HOT long, so what is held over is small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            anchor = held["anchor"].to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0
            if cut:
                yield from work(held.slice(0, cut))
                held = held.slice(cut).combine_chunks()
        if held is not None and len(held):
            yield from work(held)

    return run


_CELL = "window binary, prior int, first boolean, anchor bigint, cls bigint, id bigint, place bigint, start bigint"


def _cells(span: int):
    """Fragments -> their windows: letters (2 bits each), the letter before, whether it is the fragment's first, place in the record, and the fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in _PARTS}
            raw = batch.column("letters").to_pylist()
            for a in range(0, len(raw), 1000):
                letters = _unpack(raw[a : a + 1000])
                n, width = letters.shape
                row, offset = np.nonzero(np.arange(width - span + 1) <= (c["size"][a : a + 1000] - span)[:, None])
                room = -(-span // 4) * 4
                padded = np.concatenate([letters, np.zeros((n, room - span), np.uint8)], axis=1)
                for i in range(0, len(row), 50_000):
                    r, o = row[i : i + 50_000], offset[i : i + 50_000]
                    w = padded[r[:, None], o[:, None] + np.arange(room)]
                    w[:, span:] = 0
                    w = w.reshape(len(r), -1, 4) @ np.array([64, 16, 4, 1], np.uint8)
                    prior = np.where(o > 0, letters[r, np.maximum(o - 1, 0)], c["prior"][a + r])
                    packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(w.shape[1]), len(w), [None, pa.py_buffer(np.ascontiguousarray(w, np.uint8))]).cast(pa.binary())
                    columns = [prior.astype(np.int32), o == 0, *(c[m][a + r] for m in ("anchor", "cls", "id")), c["start"][a + r] + o, c["start"][a + r]]
                    yield pa.RecordBatch.from_arrays([packed, *map(pa.array, columns)], names=[x.split()[0] for x in _CELL.split(", ")])

    return run


def _rows(sequences: DataFrame) -> DataFrame:
    """(id, seq, cls, h2); the two hashes of the upper-cased text stand for it."""
    rows = sequences.filter(F.col("id").isNotNull()).select(F.col("id").cast("bigint").alias("id"), F.translate("sequence", "acgt", "ACGT").alias("seq"))
    return rows.withColumns({"cls": F.xxhash64("seq"), "h2": F.xxhash64(F.lit(1), "seq")})


def _classes(rows: DataFrame) -> DataFrame:
    """(cls, h2, rep) of the texts that several ids have; rep is the smallest id."""
    groups = rows.groupBy("cls", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last"))
    return materialised(groups.filter("rep <> last").drop("last"), "p3-classes")


def _members(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, id) of all records of those classes; a class's one row meets all its copies, whose side is split where it is hot (AQE)."""
    return rows.select("cls", "h2", "id").join(classes.drop("rep"), ["cls", "h2"], "left_semi").select("cls", "id").distinct()


def _fragments(rows: DataFrame, classes: DataFrame, span: int, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """Fragments of one record a class whose anchors several classes have: those of usual anchors, and of crowded ones, if there are any."""
    one = rows.filter(F.length("seq") >= span).join(classes, ["cls", "h2"], "left").filter(F.col("rep").isNull() | (F.col("rep") == F.col("id")))
    cut = materialised(one.select("id", "cls", "seq").mapInArrow(_cut(span), _FRAGMENT), "p3-fragments")
    many = cut.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo <> hi")
    many = materialised(many.select("anchor", (F.col("n") > hot).alias("hot")), "p3-anchors")
    few = cut.join(many.filter("not hot").drop("hot"), "anchor")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that small data isn't put into one task
    few = few.repartition(tasks, "anchor").sortWithinPartitions("anchor")
    if many.filter("hot").isEmpty():
        return few, None
    return few, cut.join(many.filter("hot").drop("hot"), "anchor", "left_semi").select(*_PARTS, "letters")


def _shared_cells(crowded: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """Windows of crowded anchors, and those of them that several classes hold: (window, begins), ``begins`` being that a repeat can
    begin there: the letters before differ somewhere, or are none."""
    cells = crowded.mapInArrow(_cells(span), _CELL)
    kept = cells.groupBy("window").agg(*[f(c).alias(f"{n}_{c}") for c in ("cls", "prior") for n, f in (("lo", F.min), ("hi", F.max))]).filter("lo_cls <> hi_cls")
    return cells, materialised(kept.select("window", ((F.col("lo_prior") < F.col("hi_prior")) | (F.col("hi_prior") == 4)).alias("begins")), "p3-windows")


def _met(cells: DataFrame, on) -> DataFrame:
    """Pairs of windows of equal letters of two classes, under a further condition."""
    x, y = cells.alias("x"), cells.alias("y")
    return x.join(y, (F.col("x.window") == F.col("y.window")) & (F.col("x.cls") < F.col("y.cls")) & on)


def _extend_pairs(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            both = lambda c: np.concatenate([batch.column(f"{c}_{s}").to_numpy(zero_copy_only=False).astype(np.int64) for s in "xy"])
            cls, ids, start, at, size = map(both, ("cls", "id", "start", "at", "size"))
            letters = _unpack(batch.column("letters_x").to_pylist() + batch.column("letters_y").to_pylist()) if n else None
            for i in range(0, n, 5000):
                x = np.arange(i, min(n, i + 5000))
                left, right = _extended(letters, x, x + n, at, size, span)
                yield _match_rows(cls, ids, start, at, x, x + n, left, left + ANCHOR + right)

    return run


def matches(sequences: DataFrame, span: int = SPAN, hot: int = HOT) -> DataFrame:
    """Matching stretches of different classes, given by their records of the smallest id: (id_a, id_b, start_a, start_b, length), places
    from 0. Every shared window lies in a match; matches of one diagonal may overlap (see ``repeats``). ``members`` has the classes."""
    rows = _rows(sequences)
    few, crowded = _fragments(rows, _classes(rows), span, hot)
    usual = few.mapInArrow(_by_anchor(lambda t: _compare(t, span, False)), _MATCH)
    if crowded is None:
        return usual.filter("id_a < id_b").drop("cls_a", "cls_b")
    cells, kept = _shared_cells(crowded, span)
    # of two fragments' equal windows the first: they begin there, or the letters before differ
    first = (F.col("x.anchor") == F.col("y.anchor")) & (F.col("x.first") | F.col("y.first") | (F.col("x.prior") != F.col("y.prior")))
    met = _met(cells.join(kept.select("window"), "window", "left_semi"), first).select(*[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "xy" for c in ("anchor", "cls", "id", "start")])
    side = lambda s: crowded.select(*[F.col(c).alias(f"{c}_{s}") for c in ("anchor", "cls", "id", "start", "at", "size", "letters")])
    for s in "xy":
        met = met.join(side(s), [f"{c}_{s}" for c in ("anchor", "cls", "id", "start")])
    every = usual.unionByName(met.mapInArrow(_extend_pairs(span), _MATCH))
    return every.filter("id_a < id_b").drop("cls_a", "cls_b")


def members(sequences: DataFrame) -> DataFrame:
    """(id, rep) of every record with an id: the smallest id of its class."""
    rows = _rows(sequences)
    return rows.join(_classes(rows), ["cls", "h2"], "left").select("id", F.coalesce("rep", "id").alias("rep")).distinct()


def _islands(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Unions of overlapping or touching [start, end) per key: (keys..., start, end)."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    seen = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("__new", F.when(F.col(start) <= seen, 0).otherwise(1))
    d = d.withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "__i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__i")


def repeats(found: DataFrame) -> DataFrame:
    """Maximal repeats from matches: pieces of one diagonal that overlap or touch are one repeat."""
    d = found.select("id_a", "id_b", (F.col("start_a") - F.col("start_b")).alias("diagonal"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("length")).alias("e")).distinct()
    d = _islands(d, ["id_a", "id_b", "diagonal"], "s", "e")
    return d.select("id_a", "id_b", F.col("s").alias("start_a"), (F.col("s") - F.col("diagonal")).alias("start_b"), (F.col("e") - F.col("s")).alias("length"))


def pairs(sequences: DataFrame, span: int = SPAN, hot: int = HOT) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of the records that share a span, copies included."""
    rows = _rows(sequences)
    classes = _classes(rows)
    few, crowded = _fragments(rows, classes, span, hot)
    linked = few.mapInArrow(_by_anchor(lambda t: _compare(t, span, True)), _MATCH).select("cls_a", "id_a", "cls_b", "id_b")
    if crowded is not None:
        cells, kept = _shared_cells(crowded, span)
        begins = cells.join(kept.filter("begins").select("window"), "window", "left_semi")
        met = _met(begins, (F.col("x.prior") == 4) | (F.col("x.prior") != F.col("y.prior")))
        linked = linked.unionByName(met.select(*[F.col(f"{s}.{c}").alias(f"{c}_{t}") for s, t in zip("xy", "ab") for c in ("cls", "id")]))
    linked = linked.distinct()
    own = materialised(_members(rows, classes), "p3-members")
    for s in "ab":
        linked = linked.join(own.select(F.col("cls").alias(f"cls_{s}"), F.col("id").alias(f"m_{s}")), f"cls_{s}", "left").withColumn(f"id_{s}", F.coalesce(f"m_{s}", f"id_{s}")).drop(f"m_{s}")
    linked = linked.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    valid = rows.filter(F.col("seq").rlike(f"[ACGT]{{{span}}}")).join(classes, ["cls", "h2"]).filter(F.col("id") == F.col("rep")).select("cls").distinct()
    copies = own.join(valid, "cls", "left_semi")
    x, y = copies.alias("x"), copies.alias("y")
    same = x.join(y, (F.col("x.cls") == F.col("y.cls")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
    return linked.filter("id_a < id_b").unionByName(same).distinct()


def shared(sequences: DataFrame, span: int = SPAN, hot: int = HOT) -> DataFrame:
    """(id, n_bases, shared_bases, share) of every record with an id: its letters, and how many lie in a span that another record
    holds too. A null sequence counts as empty, an empty one has share 0. No pairs are formed: the work follows the windows."""
    rows = _rows(sequences)
    classes = _classes(rows)
    few, crowded = _fragments(rows, classes, span, hot)
    marked = few.mapInArrow(_by_anchor(lambda t: _mark(t, span)), "cls bigint, id bigint, s bigint, e bigint")
    if crowded is not None:
        cells, kept = _shared_cells(crowded, span)
        marked = marked.unionByName(cells.join(kept.select("window"), "window", "left_semi").select("cls", "id", F.col("place").alias("s"), (F.col("place") + span).alias("e")))
    covered = _islands(marked, ["cls", "id"], "s", "e").groupBy("cls", "id").agg(F.sum(F.col("e") - F.col("s")).alias("__some"))
    # with a copy elsewhere, every run of span letters is shared
    runs = F.aggregate(F.regexp_extract_all("seq", F.lit(f"[ACGT]{{{span},}}"), F.lit(0)), F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    every = rows.join(classes, ["cls", "h2"], "left").select("id", "cls", F.coalesce(F.length("seq"), F.lit(0)).cast("bigint").alias("n_bases"), F.when(F.col("rep").isNotNull() & F.col("seq").isNotNull(), runs).alias("__all"))
    got = every.join(covered, ["cls", "id"], "left").withColumn("shared_bases", F.coalesce("__all", "__some", F.lit(0)))
    return got.select("id", "n_bases", "shared_bases", F.when(F.col("n_bases") > 0, F.col("shared_bases") / F.col("n_bases")).otherwise(0.0).alias("share"))
