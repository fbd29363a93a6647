"""Similar codes, components and groups of copies against brute force, with hot keys."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weir.functions import text
from weir.operators import components, duplicates, near_codes, spread


@pytest.fixture
def all_is_heavy(monkeypatch):
    """A key of more than two rows is dealt over parts."""
    monkeypatch.setattr(spread, "LIGHT", 2)


def codes(seed: int, n: int) -> list[tuple]:
    """Unlike codes, families a few bits apart, many with equal halves, copies, null codes and ids."""
    rnd = random.Random(seed)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = []
    for k in range(n):
        kind = k % 4
        code = rnd.getrandbits(64)
        if kind == 1:
            code = 0x0123456789ABCDEF
        elif kind == 2:
            code = (code >> 32) << 32 | 0x5555AAAA
        for _ in range(rnd.randint(0, 14) if kind else 0):
            code ^= 1 << rnd.randrange(64)
        out.append((k, signed(code)))
    return out + [(n + k, out[5][1]) for k in range(7)] + [(n + 9, None), (None, out[3][1])]


@pytest.mark.parametrize("similarity", [100, 97, 90, 80, 70])
def test_similar_pairs_are_all(spark, similarity, all_is_heavy):
    rows = codes(similarity, 260)
    got = duplicates.similar_pairs(spark.createDataFrame(rows, "id long, code long"), similarity).collect()
    d = duplicates.max_distance(similarity)
    least = {}
    for i, c in rows:
        if i is not None and c is not None:
            least[c] = min(i, least.get(c, i))
    mask = (1 << 64) - 1
    want = {(i, j, ((a ^ b) & mask).bit_count()) for a, i in least.items() for b, j in least.items() if i < j and ((a ^ b) & mask).bit_count() <= d}
    want |= {(least[c], i, 0) for i, c in rows if i is not None and c is not None and least[c] != i}
    assert Counter(map(tuple, got)) == Counter(want) and want


def brute_pairs(rows: list[tuple], d: int) -> Counter:
    mask, rows = (1 << 64) - 1, [r for r in rows if None not in r]
    apart = lambda a, b: ((a ^ b) & mask).bit_count()
    return Counter((i, j, apart(a, b)) for i, a in rows for j, b in rows if i < j and apart(a, b) <= d)


@pytest.mark.parametrize("shard", [7, 1 << 16])
def test_blocks_miss_nothing(spark, monkeypatch, shard):
    """In a few shards and many: every pair, copies' pairs included, and groups as the pairs make them."""
    monkeypatch.setattr(near_codes, "SHARD", shard)
    rows = codes(7, 40)
    table = spark.createDataFrame(rows, "id long, code long")
    want = brute_pairs(rows, 13)
    assert Counter(map(tuple, duplicates.all_similar_pairs(table, 80).collect())) == want and sum(k[2] == 0 for k in want) > 20
    got = {r["id"]: r["group_id"] for r in duplicates.similar_groups(table, 80).collect()}
    assert got == brute_components([k[:2] for k in want]) and got


@pytest.mark.parametrize("cut", [1, 20, 45])
def test_tiles_miss_nothing(monkeypatch, cut):
    """Tiles smaller than a block, links joined a few at a time: of two shards what lies between them, of one what lies in it."""
    for name, value in (("WIDE", 11), ("HIGH", 3), ("HELD", 5)):
        monkeypatch.setattr(near_codes, name, value)
    rows = [(k, c) for k, (_, c) in enumerate(r for r in codes(7, 40) if None not in r)][:45]
    want = Counter({k: n for k, n in brute_pairs(rows, 13).items() if cut == len(rows) or k[0] < cut <= k[1]})
    got = near_codes._near(np.array([c for _, c in rows]).view(np.uint64), cut, 13)
    assert Counter((int(x), int(y), int(n)) for a, b, d in got for x, y, n in zip(a, b, d, strict=True)) == want
    batch = pa.RecordBatch.from_pydict({"id": [k for k, _ in rows], "code": [c for _, c in rows], "shard": [int(k >= cut) for k, _ in rows], "own": [True] * len(rows), "block": [0] * len(rows)})
    links = [tuple(r.values()) for out in near_codes._links(13)(iter([batch.slice(0, 30), batch.slice(30)])) for r in out.to_pylist()]
    assert brute_components(links) == brute_components([k[:2] for k in want])


def test_no_codes_are_no_pairs(spark):
    none = spark.createDataFrame([], "id long, code long")
    assert duplicates.all_similar_pairs(none, 80).count() == duplicates.similar_pairs(none, 80).count() == duplicates.similar_groups(none, 80).count() == 0


def test_text_codes_are_as_by_replacing(spark):
    texts = ["", "lll the he", "llll", None, "th" * 3, "ué un qu qu é"]
    pieces = ["th", "he", "ll"] + ["qu"] * 61
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(text.odd_counts("t", pieces)).collect()]
    want = [None if t is None else sum((len(t) - len(t.replace(p, ""))) // 2 % 2 << k for k, p in enumerate(pieces)) for t in texts]
    assert got == [w if w is None or w < 1 << 63 else w - (1 << 64) for w in want]


def test_few_pairs_are_met(spark):
    rnd = random.Random(4)
    reps = spark.createDataFrame([(k, rnd.getrandbits(64) - (1 << 63)) for k in range(2000)], "id long, code long")
    met, _ = duplicates.candidates(reps, 13)
    assert met.count() < 0.05 * 2000 * 1999 / 2


@pytest.mark.parametrize(("distance", "n"), [(0, 10), (1, 10**9), (6, 1000), (13, 100), (13, 10**6), (13, 10**12), (19, 10**6), (63, 100)])
def test_segment_plans_miss_nothing(distance, n):
    sizes, radii = duplicates.segment_plan(distance, n)
    # a pair that is beyond the radius in every segment is beyond the distance
    assert sum(sizes) == 64 and sum(r + 1 for r in radii) > distance and all(r >= 0 for r in radii)


def brute_components(links) -> dict:
    label = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a in label and b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed, all_is_heavy):
    rnd = random.Random(seed)
    links = [(-7, k) for k in range(1, 120)] + [(k, k + 1) for k in range(200, 260)] + [(261 + k, 260 + k) for k in range(30)]
    links += [(rnd.randrange(300, 700), rnd.randrange(300, 700)) for _ in range(150)] + [(5, 5), (None, 3), (3, None), (1, -7), (900, 901), (901, 900), (901, 900)]
    rnd.shuffle(links)
    got = components.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()
    assert len(got) == len({r.id for r in got}) and {r.id: r.group_id for r in got} == brute_components(links)


def test_components_of_names_and_of_nothing(spark):
    got = components.components(spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("z", "z")], "a string, b string"))
    assert {tuple(r) for r in got.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    for links in ([], [(1, 1), (None, 2)]):
        got = components.components(spark.createDataFrame(links, "a long, b long"))
        assert got.columns == ["id", "group_id"] and got.count() == 0


def test_a_hot_group_of_copies(spark, all_is_heavy):
    rnd = random.Random(1)
    files = [(k, f"p/{k % 50:03d}/{'x' * (k % 7)}{k}", 10, float(rnd.randint(0, 5)), rnd.choice([None, 5, 6]), "hot" if k % 3 else f"t{k // 9}") for k in range(300)]
    df = spark.createDataFrame([(*f, 0) for f in files], "id long, path string, size long, modified double, pixels long, content string, extra int").repartition(5)
    groups = duplicates.exact_groups(df)
    by = {}
    for f in files:
        by.setdefault(f[5], []).append(f)
    by = {min(f[0] for f in g): g for g in by.values() if len(g) > 1}
    assert {(r.id, r.group_id) for r in groups.collect()} == {(f[0], k) for k, g in by.items() for f in g}
    best = {
        "largest": lambda f: (f[4] is None, -(f[4] or 0), -f[2], f[3]), "oldest": lambda f: (f[3], len(f[1])), "newest": lambda f: (-f[3], len(f[1])), "shortest": lambda f: (len(f[1]), f[3]),
    }
    for rule, order in best.items():
        got = {r.group_id: r.id for r in duplicates.mark(groups, rule).where("keep").collect()}
        assert got == {k: min(g, key=lambda f: (*order(f), f[1].lower(), f[1]))[0] for k, g in by.items()}


def test_spread_join_keeps_every_row(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), "id")
    others = spark.range(0, 1000, 2).select(F.col("id").alias("k"), F.lit(1).alias("x")).unionByName(spark.createDataFrame([(7, 2), (7, 3)], "k long, x int"))
    heavy = spark.createDataFrame([(7, 13), (0, 2)], "k long, parts int")
    for how in ("inner", "left"):
        got = spread.spread_join(rows, others, ["k"], heavy, ["id"], how)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, rows.join(others, ["k"], how).collect()))


def test_pairs_of_many_tiles_are_sent_in_large_batches_with_the_smaller_id_first():
    n = 2000
    codes = np.random.default_rng(7).integers(0, 1 << 8, n)
    ids = np.random.default_rng(8).permutation(n)
    block = pa.RecordBatch.from_pydict({"id": [f"{k:04}" for k in ids], "code": codes, "shard": np.zeros(n, np.int32), "own": np.ones(n, bool), "block": np.zeros(n, np.int32)})
    got = list(near_codes._pairs(2)(iter([block])))
    assert len(got) <= -(-sum(b.num_rows for b in got) // near_codes.BATCH)
    away = np.bitwise_count(codes[:, None] ^ codes[None, :])
    want = sorted((*sorted((f"{ids[i]:04}", f"{ids[j]:04}")), int(away[i, j])) for i, j in zip(*np.nonzero(np.triu(away <= 2, 1)), strict=True))
    assert sorted(r for b in got for r in zip(*(c.to_pylist() for c in b.columns), strict=True)) == want


def test_places_of_hits():
    for size in (0, 1, 7, 8, 9, 1000, 1003):
        for share in (0, 0.01, 0.5, 1):
            hit = np.random.default_rng(size).random(size) < share
            assert near_codes._places(hit).tolist() == np.flatnonzero(hit).tolist()


def test_odd_counts_of_pairs_of_letters_and_of_other_pieces(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("lltheanéL\0 \n😀") for _ in range(rnd.randint(0, 60))) for _ in range(500)] + [None, "", "l", "ll", "lll", "l" * 28]
    for pieces in (["th", "he", "ll", "an", "\0l"], ["ll", "th", "l", "the", "é", "th", "aa"]):
        got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(text.odd_counts("t", pieces)).collect()]
        assert got == [None if t is None else sum((t.count(piece) & 1) << k for k, piece in enumerate(pieces)) for t in texts]
