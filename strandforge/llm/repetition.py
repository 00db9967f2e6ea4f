"""Repetition inside a single document (problem 10).

Two measures. ``fertility`` is the method named for the problem: characters per token, byte-fallback share and token entropy by public
vocabularies, the last also over phrases of 8 tokens, with rejection bands per script that are fitted on all clean texts. It has no positions and can't tell *which* characters repeat, so ``repeated``, which gives the share of a text's
characters that repeat earlier content, is computed from the windows of 32 code points themselves.

Windows: a text's code points are hashed for all windows of 32 at once by doubling (2, 4, ..., 32), for all texts of a batch
in one array. Windows of one text with equal hashes are compared letter by letter with the first of them, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandforge.llm import encode
from strandforge.session import materialised

WINDOW = 32
#: Code points hashed at once; a longer text is hashed alone.
CHUNK = 1_000_000
_SEP = np.uint32(0xFFFFFFFF)


def normalise(code: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts one after the other and their ends -> the same, normalised.

    Runs of space, tab, CR and LF become one space, a space at either end goes, A to Z become lower case.
    """
    space = (code == 32) | (code == 9) | (code == 10) | (code == 13)
    first = np.zeros(len(code), bool)
    starts = np.append(0, ends[:-1])
    first[starts[starts < ends]] = True
    before = np.empty(len(code), bool)
    before[:1], before[1:] = True, space[:-1]
    keep = ~(space & (before | first))
    kept = np.concatenate([[0], np.cumsum(keep)])
    code = np.where((code >= 65) & (code <= 90), code + 32, np.where(space, 32, code))[keep]
    ends = kept[ends]
    starts = np.append(0, ends[:-1])
    # at most one space is left at a text's end
    some = ends > starts
    trailing = np.zeros(len(code), bool)
    last = ends[some] - 1
    trailing[last[code[last] == 32]] = True
    kept = np.concatenate([[0], np.cumsum(~trailing)])
    return code[~trailing], kept[ends]


def _first_equal(code: np.ndarray, place: np.ndarray, key: np.ndarray, window: int) -> np.ndarray:
    """Of the windows at ``place`` (ascending) those whose letters and key equal an earlier one's; hashes only propose."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.append(False, k[1:] == k[:-1])
    if not same.any():
        return place[:0]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(k))))
    a, b = place[order[head[same]]], place[order[same]]
    equal = np.ones(len(a), bool)
    for i in range(window):
        equal &= code[a + i] == code[b + i]
    if equal.all():
        return b
    # some hashes of different windows are equal: those windows are compared as they are
    out, seen = [b[equal]], {}
    doubtful = np.isin(k, k[same][~equal])
    for p in np.sort(place[order[doubtful]]):
        w = (int(key[np.searchsorted(place, p)]), code[p : p + window].tobytes())
        if w in seen:
            out.append(np.array([p]))
        seen[w] = p
    return np.unique(np.concatenate(out))


def repeated_counts(texts: list[str], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Of each normalised text its length n and how many code points lie in a window that also starts earlier in it."""
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    code, ends = normalise(raw, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))
    starts = np.append(0, ends[:-1])
    n = ends - starts
    if len(code) < window:
        return n, np.zeros(len(texts), np.int64)
    owner = np.repeat(np.arange(len(texts)), n)
    h, size, factor = code.astype(np.uint64) + np.uint64(0x9E37), 1, 0xD6E8FEB86659FD93
    while size < window:
        step = min(size, window - size)
        h = h[: len(h) - step] * np.uint64(factor) + h[step:]
        h ^= h >> np.uint64(29)
        size += step
        factor = (factor * factor + 2 * size) % 2**64 | 1
    place = np.flatnonzero(owner[: len(h)] == owner[window - 1 :])
    key = h[place] ^ (owner[place].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    again = _first_equal_within(code, place, key, owner, window)
    edge = np.zeros(len(code) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return n, covered[ends] - covered[starts]


def _first_equal_within(code: np.ndarray, place: np.ndarray, key: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """``_first_equal`` with the text as part of what must be equal."""
    order = np.argsort(key)
    k, o = key[order], owner[place[order]]
    same = np.append(False, k[1:] == k[:-1])
    if not same.any():
        return place[:0]
    touched = same | np.append(same[1:], False)
    some = np.sort(order[touched])
    if (o[1:][same[1:]] == o[:-1][same[1:]]).all():
        return _first_equal(code, place[some], key[some], window)
    parts = [_first_equal(code, place[s], key[s], window) for s in np.split(some, np.flatnonzero(np.diff(owner[place[some]])) + 1)]
    return np.concatenate(parts)


def repeated(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n, repeated, share) of each non-null text: its normalised length, its repeated code points, and their share.

    Texts shorter than the window repeat nothing; an empty text has n 0 and share 0. Rows stand as they are, repeated rows
    and null ids too. Texts of any length are taken whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in encode.text_chunks(batch, "text", CHUNK):
                n, again = repeated_counts(texts, window)
                share = again / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n), pa.array(again), pa.array(share)], names=["doc_id", "n", "repeated", "share"])

    rows = documents.select("doc_id", "text").filter(F.col("text").isNotNull())
    return rows.mapInArrow(run, "doc_id bigint, n bigint, repeated bigint, share double")


def found(documents: DataFrame, least_n: int = 100, least_share: float = 0.30) -> DataFrame:
    """doc_id of texts with n >= least_n of which at least ``least_share`` repeats."""
    return repeated(documents).filter((F.col("n") >= least_n) & (F.col("share") >= least_share)).select("doc_id")


PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Tokens a phrase.
PHRASE = 8
#: A text is clean if less than this share of it repeats.
CLEAN = 0.05
#: How far beside a band's end, as a share of the values, the edges lie between which it is sought; any choice gives the same end.
NEAR = 0.002
#: Phrases that occur twice in ``s`` of a text lower the entropy of its phrases by 2 s bits.
LEAST_GAP = 0.6

#: Scripts by the first and last code point of their main blocks; other letters count as ``other``.
SCRIPTS = {"latin": (0x41, 0x24F), "greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x52F), "arabic": (0x600, 0x6FF), "devanagari": (0x900, 0x97F), "kana": (0x3040, 0x30FF), "han": (0x4E00, 0x9FFF), "hangul": (0xAC00, 0xD7A3)}
_SCRIPT_NAMES = [*SCRIPTS, "other"]


def scripts(texts: list[str]) -> list[str]:
    """The script that most code points of each text belong to; ``other`` for none."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    count = np.zeros((len(SCRIPTS) + 1, len(texts)), np.int64)
    for i, (lo, hi) in enumerate(SCRIPTS.values()):
        count[i] = np.bincount(owner[(code >= lo) & (code <= hi)], minlength=len(texts))
    count[-1] = count[:-1].max(axis=0) == 0
    return [_SCRIPT_NAMES[i] for i in count.argmax(axis=0)]


def _entropy(owner: np.ndarray, item: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each owner's distribution of items, and its number of items."""
    total = np.bincount(owner, minlength=n)
    if not len(owner):
        return np.zeros(n), total
    order = np.lexsort((item, owner))
    o, x = owner[order], item[order]
    start = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (x[1:] != x[:-1])))
    each = np.diff(np.append(start, len(o)))
    p = each / total[o[start]]
    return np.bincount(o[start], weights=-p * np.log2(p), minlength=n), total


def measures(texts: list[str], own: encode.Encoder, model, is_byte: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of ``token_measures`` as arrays, with masked entries as NaN."""
    n = len(texts)
    tokens = own.count(texts)
    lists = model.encode(texts, num_threads=1)
    count = np.fromiter(map(len, lists), np.int64, n)
    flat = np.fromiter((t for ids in lists for t in ids), np.int64, int(count.sum()))
    owner = np.repeat(np.arange(n), count)
    chars = np.fromiter(map(len, texts), np.int64, n)
    entropy, _ = _entropy(owner, flat, n)
    h = np.zeros(max(0, len(flat) - PHRASE + 1), np.uint64)
    for i in range(PHRASE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + flat[i : i + len(h)].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(29)
    whole = owner[: len(h)] == owner[len(owner) - len(h) :]
    phrase, many = _entropy(owner[: len(h)][whole], h[whole], n)
    gap = np.log2(np.maximum(many, 1)) - phrase
    nothing = np.where(count == 0, np.nan, 0.0)
    return {
        "chars": chars,
        "chars_per_token": np.where(tokens == 0, np.nan, chars / np.maximum(tokens, 1)),
        "byte_share": np.bincount(owner, weights=is_byte[flat], minlength=n) / np.maximum(count, 1) + nothing,
        "entropy": entropy + nothing,
        "phrase_gap": np.maximum(gap, 0.0) + nothing,
    }


_MEASURES = ("chars_per_token", "byte_share", "entropy", "phrase_gap")


def token_measures(documents: DataFrame, path: str = encode.VOCABULARY, pieces: str = PIECES, shares: bool = False) -> DataFrame:
    """(doc_id, lang, script, chars, chars_per_token, byte_share, entropy, phrase_gap) of each non-null text.

    chars_per_token by the byte-level vocabulary (null without tokens); the others by the piece vocabulary: byte_share, the share of
    tokens that are single bytes for want of a piece; entropy (bits) of the text's own token distribution; phrase_gap, how far (bits)
    the entropy of its phrases of PHRASE tokens is below the largest possible, that of phrases which are all different. An empty
    text has no tokens and nulls in all four. With ``shares`` also ``share``, the repeated share of each text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        own, model = encode.encoder(path), sentencepiece.SentencePieceProcessor(model_file=pieces)
        is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        for batch in batches:
            for a, b, texts in encode.text_chunks(batch, "text", CHUNK):
                got = measures(texts, own, model, is_byte)
                columns = [*(batch.column(c).slice(a, b - a) for c in ("doc_id", "lang")), pa.array(scripts(texts), pa.string()), pa.array(got["chars"])]
                columns += [pa.array(got[c], mask=np.isnan(got[c])) for c in _MEASURES]
                if shares:
                    n, again = repeated_counts(texts)
                    columns.append(pa.array(again / np.maximum(n, 1)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "lang", "script", "chars", *_MEASURES, *(["share"] if shares else [])]
    rows = documents.select("doc_id", "lang", "text").filter(F.col("text").isNotNull())
    kinds = ["bigint", "string", "string", "bigint", *["double"] * (len(names) - 4)]
    return rows.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in zip(names, kinds)))


def _ends(values: DataFrame, tail: float) -> DataFrame:
    """(__script, measure, x) -> (__script, measure, end, x): the ``tail`` and the 1 - ``tail`` quantile of each group, as ends ``low`` and ``high``.

    The q quantile is the smallest value whose share of values up to it is at least q; nulls are left out. It is exact: approximate edges
    beside the ends cut the values into classes, exact counts of the classes tell the one that holds an end, and the different
    values of that class alone are ordered.
    """
    keys = ["__script", "measure"]
    values = values.filter(F.col("x").isNotNull())
    near = [F.lit(min(1.0, max(0.0, q + d))) for q in (tail, 1 - tail) for d in (-NEAR, NEAR)]
    # written, as the classes are computed twice and an approximate edge need not come out the same again
    edges = materialised(values.groupBy(*keys).agg(F.percentile_approx("x", F.array(*near), F.lit(1_000)).alias("edges")), "p10-edges")  # a row a script and measure
    placed = values.join(F.broadcast(edges), keys).select(*keys, "x", F.size(F.filter("edges", lambda e: e < F.col("x"))).alias("class"))
    group = Window.partitionBy(*keys)
    counts = placed.groupBy(*keys, "class").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("total", F.sum("n").over(group)).withColumn("before", F.sum("n").over(group.orderBy("class")) - F.col("n"))
    ranks = [F.struct(F.lit(e).alias("end"), F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("total"))).alias("rank")) for e, q in (("low", tail), ("high", 1 - tail))]
    ends = counts.select(*keys, "class", "n", "before", F.inline(F.array(*ranks)))
    ends = ends.filter((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("n")))
    held = placed.join(F.broadcast(ends.select(*keys, "class", "end", (F.col("rank") - F.col("before")).alias("place"))), [*keys, "class"])
    held = held.groupBy(*keys, "end", "place", "x").agg(F.count(F.lit(1)).alias("n"))
    upto = held.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys, "end").orderBy("x")))
    return upto.filter(F.col("upto") >= F.col("place")).groupBy(*keys, "end").agg(F.min("x").alias("x"))


def bands(measured: DataFrame, tail: float = 0.005) -> DataFrame:
    """(__script, __chars_per_token, __byte_share, __entropy, __phrase_gap): the band of each script as (low, high), a row a script.

    ``measured`` are rows of ``token_measures`` with shares, which are read several times. Fitted on all clean ones of at least 100
    characters, from the ``tail`` to the 1 - ``tail`` quantile, exactly. The upper end of the phrase gap is at least LEAST_GAP.
    """
    clean = measured.filter((F.col("share") < CLEAN) & (F.col("chars") >= 100)).withColumnRenamed("script", "__script")
    ends = _ends(clean.unpivot(["__script"], list(_MEASURES), "measure", "x"), tail)
    one = lambda c, e: F.min(F.when((F.col("measure") == c) & (F.col("end") == e), F.col("x")))
    got = ends.groupBy("__script").agg(*[F.array(one(c, "low"), one(c, "high")).alias(f"__{c}") for c in _MEASURES])
    return got.withColumn("__phrase_gap", F.array(F.lit(0.0), F.greatest(F.col("__phrase_gap")[1], F.lit(LEAST_GAP))))


def fertility(documents: DataFrame, tail: float = 0.005, path: str = encode.VOCABULARY, pieces: str = PIECES) -> DataFrame:
    """Token measures of each text with ``repetitive``, its phrase gap being above its script's band, and ``rejected``: outside the band in
    any measure.

    Characters per token and entropy have a band with two ends, the byte share and the phrase gap an upper end only. Texts without
    tokens are rejected, not repetitive. Texts of a script that no clean text has are held against LEAST_GAP alone. The measures
    are computed once and written, for the bands and the result.
    """
    rows = materialised(token_measures(documents, path, pieces, shares=True), "p10-measures")
    joined = rows.join(F.broadcast(bands(rows, tail)), F.col("script") == F.col("__script"), "left")  # a row a script
    low = (F.col("chars_per_token") < F.col("__chars_per_token")[0]) | (F.col("entropy") < F.col("__entropy")[0])
    repetitive = F.col("phrase_gap") > F.coalesce(F.col("__phrase_gap")[1], F.lit(LEAST_GAP))
    high = F.lit(False)
    for c in _MEASURES[:3]:
        high = high | F.coalesce(F.col(c) > F.col(f"__{c}")[1], F.lit(False))
    odd = F.coalesce(low, F.lit(False)) | high | F.col("chars_per_token").isNull() | F.col("entropy").isNull()
    repetitive = F.coalesce(repetitive, F.lit(False))
    return joined.select("doc_id", "lang", "script", "chars", *_MEASURES, repetitive.alias("repetitive"), (odd | repetitive).alias("rejected"))


def fertility_recall(documents: DataFrame, **options) -> DataFrame:
    """One row: the cases of ``found``, those that ``fertility`` calls repetitive, those in both, recall and precision."""
    cases = found(documents).select(F.col("doc_id").alias("__id"), F.lit(True).alias("__case"))
    both = fertility(documents, **options).select("doc_id", "repetitive", "chars").join(cases, F.col("doc_id") == F.col("__id"), "left")
    case, said = F.coalesce("__case", F.lit(False)), F.col("repetitive") & (F.col("chars") >= 100)
    one = both.agg(F.count_if(case).alias("cases"), F.count_if(said).alias("said"), F.count_if(case & said).alias("hits"))
    share = lambda n: F.when(F.col(n) > 0, F.col("hits") / F.when(F.col(n) > 0, F.col(n))).otherwise(1.0)
    return one.select("cases", "said", "hits", share("cases").alias("recall"), share("said").alias("precision"))
