import random
import re

import pytest
from pyspark.sql import functions as F

from strandforge.llm import graph, neardup, spans

SCHEMA = "id bigint, name string, sequence string, seq string, key string, tbl string"


def frame(spark, rows):
    return spark.createDataFrame([(i, "n", s, "x", "y", "z") for i, s in rows], SCHEMA).repartition(3)


def sets(rows):
    out = {}
    for i, s in rows:
        if i is None or s is None:
            continue
        up = "".join(c.upper() if c in "acgt" else c for c in s)
        got = {m.group()[j : j + 12] for m in re.finditer("[ACGT]{12,}", up) for j in range(len(m.group()) - 11)}
        if got:
            out[i] = got
    return out


def similar(rows):
    s = sets(rows)
    ids = sorted(s)
    return {(a, b) for a in ids for b in ids if a < b and len(s[a] & s[b]) * 5 >= len(s[a] | s[b]) * 3}


def mutate(rng, s):
    s = list(s)
    for _ in range(rng.randint(0, 3)):
        p = rng.randrange(len(s))
        kind = rng.choice("sid")
        if kind == "s":
            s[p] = rng.choice("ACGTNacgt")
        elif kind == "i":
            s.insert(p, rng.choice("ACGT"))
        else:
            del s[p]
    if rng.random() < 0.2:
        cut = rng.randrange(len(s))
        s = s[cut:] + s[:cut]
    return "".join(s)


def corpus(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ACGT") for _ in range(rng.choice([30, 90, 300]))) for _ in range(n // 4)]
    rows = [(i, mutate(rng, rng.choice(base))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (None, base[0]), (n + 2, "ACGT"), (n + 3, "N" * 50), (n + 4, "A" * 40), (n + 5, "a" * 60), (n + 6, base[1]), (n + 7, base[1].lower())]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_pairs_equal_brute_force(spark, seed):
    a, b = corpus(seed, 160), corpus(seed + 10, 60)
    got = {(r.table_name, r.id_a, r.id_b) for r in neardup.found({"reads": frame(spark, a), "sequences": frame(spark, b)}).collect()}
    want = {("reads", *p) for p in similar(a)} | {("sequences", *p) for p in similar(b)}
    assert got == want


def test_groups(spark):
    a = corpus(5, 120)
    rows = neardup.groups({"reads": frame(spark, a), "sequences": frame(spark, [])}).collect()
    links, parent = {}, {}
    ids = [i for i, _ in a if i is not None]
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for x, y in similar(a):
        links[x], links[y] = links.get(x, 0) + 1, links.get(y, 0) + 1
        p, q = sorted((find(x), find(y)))
        parent[q] = p
    assert {r.id: (r.group_id, r.n_links) for r in rows} == {i: (find(i), links.get(i, 0)) for i in ids}


def test_copies_give_no_candidates(spark):
    """n copies are one class: no band is shared, no pair is verified; only p7_found expands them."""
    rng = random.Random(3)
    text = "".join(rng.choice("ACGT") for _ in range(300))
    for n in (10, 40):
        tables = {"reads": frame(spark, [(i, text) for i in range(n)]), "sequences": frame(spark, [])}
        records = neardup._records(tables)
        copies = neardup._valid_copies(records, neardup.classes(records))
        assert copies.count() == n and neardup.similar_pairs(records, copies).count() == 0
        assert neardup.found(tables).count() == n * (n - 1) // 2
        assert {(r.group_id, r.n_links) for r in neardup.groups(tables).collect()} == {(0, n - 1)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (95, 100), (7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.root for r in graph.components(df, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}
    assert graph.components(df.limit(0), "a", "b").count() == 0


def truth(rows, span):
    where = {}
    for i, s in rows:
        if i is None or s is None:
            continue
        for m in re.finditer(f"[ACGT]{{{span},}}", s.upper()):
            for j in range(len(m.group()) - span + 1):
                where.setdefault(m.group()[j : j + span], []).append((i, m.start() + j))
    pairs, cover = set(), {}
    for places in where.values():
        ids = {i for i, _ in places}
        if len(ids) > 1:
            pairs |= {(a, b) for a in ids for b in ids if a < b}
            for i, p in places:
                cover.setdefault(i, set()).update(range(p, p + span))
    return pairs, {i: len(c) for i, c in cover.items()}


def span_corpus(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    shared = [word(n) for n in (39, 40, 41, 90, 200)] + ["A" * 60, "AC" * 40, word(10) * 7]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += [word(rng.randint(0, 60)), rng.choice([*shared, "N", "nn", "A" * 39])]
        s = "".join(parts)
        rows.append((i, s if rng.random() < 0.7 else s.lower()))
    return rows + [(60, None), (61, ""), (None, shared[4]), (62, shared[4]), (63, shared[4]), (64, shared[4] * 2), (65, word(39))]


@pytest.mark.parametrize("seed,hot", [(1, 512), (2, 2), (3, 5)])
def test_spans_equal_brute_force(spark, seed, hot):
    rows = span_corpus(seed)
    df = frame(spark, rows)
    pairs, cover = truth(rows, 40)
    assert {(r.id_a, r.id_b) for r in spans.pairs(df, 40, hot).collect()} == pairs
    got = {r.id: (r.n_bases, r.shared_bases) for r in spans.shared(df, 40, hot).collect()}
    assert got == {i: (len(s or ""), cover.get(i, 0)) for i, s in rows if i is not None}
    text = {i: (s or "").upper() for i, s in rows}
    seen = spans.repeats(spans.matches(df, 40, hot)).collect()
    for r in seen:
        a, b = text[r.id_a], text[r.id_b]
        assert r.length >= 40 and a[r.start_a : r.start_a + r.length] == b[r.start_b : r.start_b + r.length]
        left = r.start_a and r.start_b and a[r.start_a - 1] == b[r.start_b - 1] and a[r.start_a - 1] in "ACGT"
        x, y = a[r.start_a + r.length :][:1], b[r.start_b + r.length :][:1]
        assert not left and not (x and x == y and x in "ACGT")


def test_long_texts_are_cut_with_overlap():
    rng = random.Random(4)
    s = "".join(rng.choice("ACGT") for _ in range(5000))
    windows = set()
    for shift, part, own in spans._pieces(["ACGT", s], 40, 700):
        for j, p in enumerate(part):
            windows |= {(int(own[j]), int(shift[j]) + i) for i in range(len(p) - 39)}
    assert windows == {(1, i) for i in range(5000 - 39)}


def test_no_sequences(spark):
    empty = frame(spark, [])
    assert spans.pairs(empty).count() == 0 and spans.shared(empty).count() == 0
    assert neardup.found({"reads": empty, "sequences": empty}).count() == 0
    only = frame(spark, [(1, None), (2, "")])
    assert [(r.n_bases, r.share) for r in spans.shared(only).collect()] == [(0, 0.0), (0, 0.0)]
    assert spans.pairs(only.withColumn("sequence", F.lit(None).cast("string"))).count() == 0


@pytest.mark.parametrize("hot", [512, 4])
def test_copies_and_common_regions_cost_little(spark, hot):
    """n copies give no match rows at all, n records with a common region one row a pair, whatever its length, and only for pairs."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    text, region = word(600), word(600)
    for n in (10, 20):
        copies = frame(spark, [(i, text) for i in range(n)])
        assert spans.matches(copies, 120, hot).count() == 0
        assert spans.pairs(copies, 120, hot).count() == n * (n - 1) // 2
        assert {(r.n_bases, r.shared_bases) for r in spans.shared(copies, 120, hot).collect()} == {(600, 600)}
        common = frame(spark, [(i, word(150) + region + word(150)) for i in range(n)])
        rows = spans._rows(common)
        few, crowded = spans._fragments(rows, spans._classes(rows), 120, hot)
        begins = few.mapInArrow(spans._by_anchor(lambda t: spans._compare(t, 120, True)), spans._MATCH).count()
        assert (crowded is None) == (hot >= n)
        if crowded is not None:
            cells, kept = spans._shared_cells(crowded, 120)
            # windows where a repeat can begin: the region's first one only (and its neighbours by chance)
            assert kept.filter("begins").count() <= 2 * n and cells.count() <= n * 781
        assert begins <= n * (n - 1) // 2
        assert spans.pairs(common, 120, hot).count() == n * (n - 1) // 2
        assert all(600 <= r.shared_bases <= 616 for r in spans.shared(common, 120, hot).collect())


def test_members(spark):
    df = frame(spark, [(3, "acgt"), (1, "ACGT"), (2, "ACGA"), (5, None), (4, None), (None, "ACGT"), (1, "ACGT")])
    assert sorted(tuple(r) for r in spans.members(df).collect()) == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 4)]
