import bisect
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from strandforge.llm import encode, packing, repetition

SCHEMA = "doc_id bigint, lang string, text string, ids string, size string, key string"
ODD = ["", " ", "\n\n", "<|endoftext|>", "a" * 5000, "漢字" * 700, "é́​﻿", "don't we'll  I'M\t\tx", "🙂🙂👩‍👩‍👧", "\x00\x01", "123 4567,89", "   lead", "trail   ", "a\r\nb", "aaaa" * 33]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(encode.VOCABULARY)
    t.encode_special_tokens = True
    return t


def texts(seed, n):
    rng = random.Random(seed)
    out = list(ODD)
    for _ in range(n):
        out.append("".join(rng.choice(["the ", "ion", "a", "e", " ", "\n", "'s", "é", "漢", "0", "!", "<|", "qu", "Z"]) for _ in range(rng.randint(0, 120))))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, "l", t, "a", "b", "c") for i, t in rows], SCHEMA)


def test_encoding_equals_library(spark, library):
    rows = [*enumerate(texts(1, 300)), (900, None), (None, "null id"), (5, "repeated id")]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in encode.encode_column(frame(spark, rows).repartition(4)).collect())
    want = sorted((-1 if i is None else i, library.encode(t, add_special_tokens=False).ids if t else []) for i, t in rows)
    assert got == want
    assert encode.encode_column(frame(spark, [])).count() == 0
    sizes = {r.doc_id: r.size for r in encode.count_column(frame(spark, rows[:50])).collect()}
    assert sizes == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows[:50]}


def test_encoding_of_the_small_table(spark, library):
    from conftest import DATA

    df = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids if r.text else [] for r in df.select("doc_id", "text").collect()}
    assert {r.doc_id: r.ids for r in encode.encode_column(df).collect()} == want


def test_speculation_and_exact_merges_agree():
    v = encode.encoder(encode.VOCABULARY).vocabulary
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlu éß") for _ in range(rng.randint(1, 14))).encode() for _ in range(3000)] + [b"x" * 3000, b"ab" * 900]
    ids, counts, failed = v.encode_words(words)
    exact = [v.ids[v.merge_exactly(w)].tolist() for w in words]
    cut = np.split(ids, np.cumsum(counts)[:-1])
    assert [c.tolist() for c in cut] == exact
    assert 0 < failed < len(words)
    assert v.encode_words([])[0].tolist() == []


def test_cache_is_bounded(monkeypatch, library):
    monkeypatch.setattr(encode, "CACHE", 50)
    e = encode.Encoder()
    for part in (texts(7, 40), texts(8, 40), texts(7, 40)):
        ids, at = e.encode(part)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t, add_special_tokens=False).ids for t in part]


def best_fit(sizes, capacity):
    bins, n = [], 0
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(bins, s)
        if i < len(bins):
            r = bins.pop(i)
        else:
            r, n = capacity, n + 1
        bisect.insort(bins, r - s)
    return n, sorted(bins)


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    for _ in range(60):
        capacity = rng.choice([5, 16, 50, 2048])
        sizes = [rng.randint(1, rng.choice([capacity, max(1, capacity // 6)])) for _ in range(rng.randint(0, 400))]
        steps, n = packing.plan(dict(Counter(sizes)), capacity)
        load = Counter()
        by_size = Counter(sizes)
        for size in by_size:
            mine = sorted(s for s in steps if s[0] == size)
            for i in range(by_size[size]):
                _, first, container, per = mine[bisect.bisect_right(mine, (size, i, 1 << 60, 0)) - 1]
                load[container + (i - first) // per] += size
        assert (n, sorted(capacity - x for x in load.values())) == best_fit(sizes, capacity)


def test_fill(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([1, 1, 1, 7, 20, 49, 50, 51, 100, 130, 0, None])) for i in range(500)] + [(3, 7), (None, 12)]
    df = spark.createDataFrame(rows, "doc_id bigint, size bigint").repartition(3)
    got = packing.fill(df, capacity=50).collect()
    load = Counter()
    pieces = {}
    for r in got:
        load[r.container] += r.length
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    assert max(load.values()) <= 50 and sorted(load) == list(range(len(load)))
    want = [x for _, s in rows if s for x in ([50] * (s // 50) + ([s % 50] if s % 50 else []) if s > 50 else [s])]
    assert sorted(r.length for r in got) == sorted(want)
    assert len(load) == best_fit(want, 50)[0]
    for i, s in rows:
        if i not in (3, None) and s:
            covered = sorted(pieces[i])
            assert covered[0][0] == 0 and sum(n for _, n in covered) == s and all(a + n == b for (a, n), (b, _) in zip(covered, covered[1:]))
    assert packing.fill(df.limit(0)).count() == 0
    u = packing.usage(packing.fill(df, capacity=50), 50).first()
    assert u.containers == len(load) and u.tokens == sum(want) and u.least <= u.containers


def brute(t, window=32):
    t = re.sub("[ \t\r\n]+", " ", t).strip(" ")
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    seen, hit = set(), bytearray(len(t))
    for i in range(len(t) - window + 1):
        w = t[i : i + window]
        if w in seen:
            hit[i : i + window] = b"\1" * window
        seen.add(w)
    return len(t), sum(hit)


@pytest.mark.parametrize("window", [32, 5])
def test_repetition_equals_brute_force(window):
    rng = random.Random(window)
    rows = [*ODD, "x" * 31, "x" * 32, "x" * 33, "Ab \n" * 40]
    rows += ["".join(rng.choice("aB \n\té🙂") for _ in range(rng.randint(0, 150))) * rng.choice([1, 1, 2, 3]) for _ in range(500)]
    n, again = repetition.repeated_counts(rows, window)
    assert list(zip(n.tolist(), again.tolist())) == [brute(t, window) for t in rows]


def test_equal_hashes_of_different_windows(monkeypatch):
    # with all hashes equal only the letters decide
    code = np.frombuffer("abcabcabxabc".encode("utf-32-le"), np.uint32)
    place = np.arange(10)
    got = repetition._first_equal(code, place, np.zeros(10, np.uint64), 3)
    seen, want = set(), []
    for i in range(10):
        w = "abcabcabxabc"[i : i + 3]
        want += [i] if w in seen else []
        seen.add(w)
    assert got.tolist() == want


def test_repetition_query(spark):
    rows = [(1, "spam and eggs for breakfast, every day. " * 5), (2, None), (3, ""), (4, "short " * 9), (None, "x" * 200), (1, "y" * 99)]
    df = frame(spark, rows)
    got = [(r.doc_id, r.n, r.repeated) for r in repetition.repeated(df).collect()]
    assert sorted(got, key=repr) == sorted(((i, *brute(t)) for i, t in rows if t is not None), key=repr)
    assert sorted(repr(r.doc_id) for r in repetition.found(df).collect()) == ["1", "None"]
    assert repetition.repeated(df.limit(0)).count() == 0


def test_fertility(spark):
    rows = [(i, f"the cat sat on mat number {i} and then it left again") for i in range(200)] + [(200, "☃☄★☆" * 30), (201, ""), (202, None), (203, "word " * 200)]
    got = {r.doc_id: r for r in repetition.fertility(frame(spark, rows)).collect()}
    assert 202 not in got and got[201].rejected and got[201].chars_per_token is None
    assert got[200].rejected and got[200].byte_share > 0.3
    assert got[203].rejected and got[203].entropy < 1.5
    assert sum(r.rejected for r in got.values()) < 20
    assert {i for i, r in got.items() if r.repetitive} == {200, 203}
    assert repetition.fertility(frame(spark, [])).count() == 0


def test_phrase_gap_and_scripts():
    import sentencepiece

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    clean = " ".join(word() for _ in range(200))
    part = " ".join(word() for _ in range(100))
    texts = [clean, part + " " + part, "", "a b", clean + " " + clean[: len(clean) // 4]]
    model = sentencepiece.SentencePieceProcessor(model_file=repetition.PIECES)
    is_byte = np.zeros(model.get_piece_size(), bool)
    got = repetition.measures(texts, encode.encoder(encode.VOCABULARY), model, is_byte)["phrase_gap"]
    assert got[0] < 1e-9 and abs(got[1] - 1) < 0.05 and np.isnan(got[2]) and got[3] < 1e-9 and 0.3 < got[4] < 0.5
    assert repetition.scripts(["abc", "Привет", "漢字かな漢", "", "12 3", "مرحبا", "नमस्ते", "a漢"]) == ["latin", "cyrillic", "han", "other", "other", "arabic", "devanagari", "latin"]


def test_fertility_finds_repetition(spark):
    """Recall and precision of the named method against the exact share, on the small tables' documents."""
    r = repetition.fertility_recall(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).first()
    assert r.cases >= 30 and r.recall >= 0.9 and r.precision >= 0.9
    assert r.cases == repetition.found(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).count()

def test_bands_of_more_texts_than_a_sample(spark):
    """With many more texts than 20,000 every clean one counts for its script's band."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=24)) for _ in range(30_000)] + ["".join(rng.choices("αβγδεζηθικλμνξοπρστυφχψω ", k=120)) for _ in range(3)]
    got = {r.doc_id: r for r in repetition.fertility(frame(spark, list(enumerate(texts)))).collect()}
    n, again = repetition.repeated_counts(texts)
    assert len(got) == len(texts) and {got[i].script for i in range(30_000)} == {"latin"} and got[30_000].script == "greek"
    odd = set()
    for part in (range(30_000), range(30_000, 30_003)):
        clean = [i for i in part if again[i] < 0.05 * n[i] and len(texts[i]) >= 100]
        for c in ("chars_per_token", "byte_share", "entropy", "phrase_gap"):
            x = np.sort([got[i][c] for i in clean])
            low, high = (x[max(1, math.ceil(q * len(x))) - 1] for q in (0.005, 1 - 0.005))
            low, high = {"byte_share": (0, high), "phrase_gap": (0, max(high, repetition.LEAST_GAP))}.get(c, (low, high))
            odd |= {i for i in part if not low <= got[i][c] <= high}
    assert {i for i, r in got.items() if r.rejected} == odd


@pytest.mark.parametrize("tail", [0.005, 0.1, 0.5])
def test_band_ends_are_exact(spark, tail):
    rng = np.random.default_rng(2)
    # one value that nearly all have, few different values, all different, two values, one value; nulls count for nothing
    groups = {"a": np.append(np.zeros(9000), rng.random(40)), "b": rng.integers(0, 7, 5000) / 7, "c": rng.random(7001), "d": np.array([2.0, 1.0]), "e": np.array([3.0])}
    rows = [(s, m, float(x) if m == "m" else None) for s, xs in groups.items() for x in xs for m in ("m", "none")]
    got = {(r["__script"], r.measure, r.end): r.x for r in repetition._ends(spark.createDataFrame(rows, "__script string, measure string, x double"), tail).collect()}
    want = {(s, "m", e): np.sort(xs)[max(1, math.ceil(q * len(xs))) - 1] for s, xs in groups.items() for e, q in (("low", tail), ("high", 1 - tail))}
    assert got == want
