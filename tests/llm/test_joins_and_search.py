"""Filter audit, interval join and vector search against brute force, with the cases that must not crash."""

from __future__ import annotations

import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.llm import audit, graph, overlaps, queries

TABLES = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- filter audit
def failing(text: str) -> str:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text) else ""
    return out + ("D" if set(text) & set("#$%&*|") else "")


def audited(docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    """Every order is gone through document by document."""
    fails = []
    for doc_id, text, lang in docs:
        mine = failing(text or "")
        if doc_id is not None and any(other is not None and other < doc_id and (text or "") == (its or "") for other, its, _ in docs):
            mine += "E"
        label = lambda k, d=doc_id: any(d is not None and row[0] == d and row[k] == 1 for row in labels)
        fails.append((lang or "", mine, label(1), label(2)))
    rows, shapley = [], Counter()
    for part in {f[0] for f in fails}:
        own = [f[1:] for f in fails if f[0] == part]
        for order in itertools.permutations("ABCDE"):
            alive = list(own)
            for step, x in enumerate(order, 1):
                gone = [f for f in alive if x in f[0]]
                alive = [f for f in alive if x not in f[0]]
                shapley[part, x] += len(gone)
                failed = sum(x in f[0] for f in own)
                rows.append([part, "".join(order), step, len(alive), len(gone), failed - len(gone), sum(f[0] == x for f in own), sum(f[1] for f in gone), sum(f[2] for f in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in rows)


def some_docs(n: int = 90) -> tuple[list[tuple], list[tuple]]:
    rnd = random.Random(3)
    word = lambda: rnd.choice(["the", "The", "cat", "50%", "Ünï", "日本", "|", "a", "B"])
    texts = [" ".join(word() for _ in range(rnd.choice([3, 150, 199, 200, 260]))) for _ in range(25)] + [" ".join(f"w{k}" for k in range(230)), "", None, "  \n\t ", "A" * 500_000, "x y\x0bz"]
    docs = [(k, rnd.choice(texts), rnd.choice(["en", "de", "", None])) for k in range(n)]
    docs += [docs[4], docs[4], (None, docs[5][1], "en"), (None, docs[5][1], "en"), (7, "another text of one id", "en")]
    labels = [(k, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for k in range(0, n, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (10_000, 1, 1)]
    return docs, labels


def as_docs(spark, docs):
    # columns with names that the operator uses itself
    return spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, part string, mask int").repartition(3)


def test_filter_audit_is_brute_force(spark):
    docs, labels = some_docs()
    rows = audit.counted(audit.failures(as_docs(spark, docs)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, audit.audit(rows).collect())) == audited(docs, labels)


def test_masks_of_every_kind():
    import pyarrow as pa

    texts = [d[1] for d in some_docs()[0]]
    want = [sum(1 << "ABCD".index(x) for x in failing(t or "")) for t in texts]
    assert audit.text_masks(pa.array(texts, pa.string())).tolist() == want
    table = audit.first_failure()
    assert table.shape == (32, 120) and not table[0].any()
    assert table[0b00100, audit.ORDERS.index("ABCDE")] == 3 and table[0b10100, audit.ORDERS.index("EABCD")] == 1


def test_filter_audit_gives_sums_of_many_parts(spark):
    docs = [(k, "one", f"p{k % 40}") for k in range(200)]
    rows = audit.counted(audit.failures(as_docs(spark, docs)), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    of = lambda batches: audit._audited(batches, rows=7, most_parts=5)
    got = rows.select("part", "mask", "good", "toxic", "n").mapInArrow(of, audit.OUT).groupBy("part", "filter_order", "step").agg(F.sum("removed").alias("removed"), F.sum("kept").alias("kept"))
    want = {r[:3]: (r[4], r[3]) for r in audited(docs, [])}
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == want


def test_filter_audit_of_nothing(spark):
    rows = audit.counted(audit.failures(as_docs(spark, [])), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert audit.audit(rows).count() == 0


# ---------------------------------------------------------------- interval join
def relation(a: tuple[int, int], b: tuple[int, int]) -> str:
    row = 0 if a[0] < b[0] else 1 if a[0] == b[0] else 2
    return overlaps.RELATIONS[row * 3 + (0 if a[1] < b[1] else 1 if a[1] == b[1] else 2)]


def every_pair(left, right):
    for i, key, s, e in left:
        for j, other, s2, e2 in right:
            if None not in (key, s, e, other, s2, e2) and key == other and s <= e and s2 <= e2 and s2 <= e and s <= e2:
                shared = None if e == e2 == overlaps.OPEN else min(e, e2) - max(s, s2) + 1
                yield i, j, relation((s, e), (s2, e2)), shared


def intervals(seed: int, n: int) -> list[tuple]:
    """One key has a third of the rows; ends are open, starts below 0, some rows broken or repeated."""
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        start = rnd.randint(-40, 200)
        end = rnd.choice([start, start + rnd.randint(0, 5), start + rnd.randint(0, 150), overlaps.OPEN])
        out.append((k, rnd.choice([1, 1, 1, 2, 3, 4, -5, 10**12]), start, end))
    out += [out[0], out[0], (n, None, 1, 2), (n + 1, 1, None, 2), (n + 2, 1, 5, None), (n + 3, 1, 9, 3), (None, 1, 0, 50), (None, 1, 0, 50)]
    return out


SIDE = "id long, key long, start long, end long"


@pytest.mark.parametrize(("span", "rows"), [(1024, 4096), (16, 20), (1, 1)])
def test_interval_joins_are_brute_force(spark, span, rows):
    left, right = intervals(1, 150), [(i or 0, *r) for i, *r in intervals(2, 120)]
    as_left = spark.createDataFrame([(*r, "y") for r in left], SIDE + ", part string").repartition(3)
    as_right = spark.createDataFrame(right, SIDE).repartition(2)
    pairs = list(every_pair(left, right))
    got = overlaps.joined(as_left, as_right, span=span, rows=rows).collect()
    assert Counter(map(tuple, got)) == Counter(pairs) and len(pairs) > 1000
    want = defaultdict(lambda: [0, None, 0])
    for i, j, kind, points in pairs:
        x = want[i, kind]
        x[0], x[2] = x[0] + 1, x[2] + 3 * j
        x[1] = x[1] if points is None else (x[1] or 0) + points
    got = overlaps.related(as_left, as_right.withColumn("measure", F.col("id") * 3), span=span, rows=rows).collect()
    assert {(r[0], r[1]): list(r)[2:] for r in got} == dict(want)


def test_interval_join_of_nothing(spark):
    some, none = spark.createDataFrame(intervals(1, 9), SIDE), spark.createDataFrame([], SIDE)
    for left, right in ((some, none), (none, some), (none, none)):
        assert overlaps.joined(left, right).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 8, 200])
def test_tree_finds_every_interval(n):
    rng = np.random.default_rng(n)
    start = rng.integers(-50, 50, n)
    end = start + rng.integers(0, 30, n)
    low = rng.integers(-60, 60, 100)
    high = low + rng.integers(0, 20, 100)
    asked, found = overlaps.Tree(start, end).meet(low, high)
    want = {(i, j) for i in range(100) for j in range(n) if start[j] <= high[i] and low[i] <= end[j]}
    assert set(zip(asked.tolist(), found.tolist(), strict=True)) == want and len(asked) == len(want)


@pytest.mark.parametrize("chunk", [1, 2, 288])
def test_sessions_are_brute_force(spark, chunk):
    rnd = random.Random(chunk)
    events = [(rnd.choice([1, 1, 2, 3]), rnd.randint(-3000, 9000), rnd.choice([True, False, None])) for _ in range(300)]
    # steps of exactly the gap, and one more
    events += [(8, 10 * k, False) for k in range(50)] + [(9, 11 * k, True) for k in range(50)] + [(None, 5, True), (1, None, True)]
    got = overlaps.sessions(spark.createDataFrame(events, "key long, at long, mark boolean"), 10, chunk=chunk).collect()
    want = []
    for key in (1, 2, 3, 8, 9):
        mine = sorted((at, bool(mark)) for k, at, mark in events if k == key and at is not None)
        runs = [[mine[0]]]
        for one in mine[1:]:
            runs.append([one]) if one[0] - runs[-1][-1][0] > 10 else runs[-1].append(one)
        want += [(key, r[0][0], r[-1][0], any(m for at, m in r if at == r[-1][0])) for r in runs]
    assert sorted(map(tuple, got)) == sorted(want)


def test_overlaps_measure_is_the_crc(spark, tmp_path):
    table = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    import datetime as dt

    day = lambda d, s=0: dt.datetime(2024, 1, d) + dt.timedelta(seconds=s)
    table("clicks", [(1, day(2), "click"), (1, day(2, 300), "view"), (1, day(2, 601), "click"), (None, day(2), "click"), (1, None, "click")], "client_id long, ts timestamp_ntz, kind string")
    table("sales", [(5, 1, "done", day(1)), (5, 1, "done", day(1)), (6, 1, "held", day(2)), (7, None, "done", day(1)), (None, 1, "done", day(3))], "sale_id long, client_id long, status string, sold_at timestamp_ntz")
    table("sale_lines", [(5, day(2, 86399)), (5, None), (None, day(9))], "sale_id long, shipped_at timestamp_ntz")
    first, second = (zlib.crc32(str((day(2, s) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)).encode()) for s in (0, 601))
    got = {(r.sale_id, r.relation): (r.n_pairs, r.overlap_slots, r.sessions_crc) for r in overlaps.op12_overlaps(spark, str(tmp_path)).collect()}
    assert got == {(5, "finished_by"): (2, 2, 2 * first), (5, "overlaps"): (2, 2, 2 * second), (6, "started_by"): (1, 1, first), (6, "equals"): (1, None, second), (None, "during"): (1, 1, second)}


# ---------------------------------------------------------------- vector search
def exact(queries, rows, k: int) -> dict[int, list[tuple]]:
    out = {}
    for q, own in queries:
        found = sorted((-float((own * v).sum()), i) for i, v in rows if i != q and len(v) == len(own))
        out[q] = [(i, -s) for s, i in found[:k]]
    return out


def searched(spark, rows, k=10, **more):
    df = spark.createDataFrame([(i, None if v is None else [float(x) if x is not None else None for x in v], 1) for i, v in rows], "id long, vector array<double>, shard int").repartition(3)
    got = defaultdict(list)
    for r in graph.nearest(df.where("id % 20 = 0"), df, k, **more).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    out = {}
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, len(found) + 1))
        out[q] = [x[1:] for x in found]
    return out


def test_nearest_vectors_of_a_graph(spark):
    """Vectors that have no structure, the hardest case; a third are copies of one, more lie close to it; lengths from 1e-3 to 1e3."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(4000, 24))
    vectors[::3] = vectors[0]
    vectors[1:1600:3] = vectors[0] + 1e-3 * rng.normal(size=vectors[1:1600:3].shape)
    vectors[2:300:3] *= rng.choice([1e-3, 1e3, 5.0], size=(100, 1))
    rows = [(i, v) for i, v in enumerate(vectors)]
    want = exact([r for r in rows if r[0] % 20 == 0], rows, 20)
    for shard_rows in (10_000, 1500):
        got = searched(spark, rows, 20, shard_rows=shard_rows)
        assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
        same = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
        assert same >= 0.97 * 20 * len(want)
        assert all(score == float((vectors[q] * vectors[i]).sum()) and i != q for q, found in got.items() for i, score in found)
        assert all(found == sorted(found, key=lambda x: (-x[1], x[0])) for found in got.values())


def test_few_vectors_are_found_exactly(spark):
    """Ties, repeated ids, other dimensions, and vectors that take no part."""
    rnd = random.Random(2)
    rows = [(i, np.array([rnd.randint(-2, 2) for _ in range(3)], float)) for i in range(120)]
    rows = [(i, v) for i, v in rows if v.any()] + [(200, np.array([1.0, -0.0])), (220, np.array([1.0, 0.0])), (201, np.array([2.0, 0.0])), (240, np.array([1.0] * 5)), (21, np.array([3.0, 0, 0])), (21, np.array([3.0, 0, 0]))]
    odd = [(300, None), (None, np.ones(3)), (320, []), (340, [0.0, -0.0, 0.0]), (360, [1.0, None, 1.0]), (380, [1.0, float("nan"), 0.0]), (400, [float("inf"), 0.0, 0.0])]
    queries_ = [r for r in rows if r[0] % 20 == 0]
    assert searched(spark, rows + odd, 4) == {q: found for q, found in exact(queries_, rows, 4).items() if found}
    assert searched(spark, [], 4) == {} and searched(spark, rows[:1], 4) == {}


def test_graph_reaches_every_node():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8)) * 5
    g = graph.Graph(np.concatenate([c + 1e-4 * rng.normal(size=(200, 8)) for c in centres]))
    nodes, _ = g.search(g.points[::7], 64)
    assert all(k in row for k, row in zip(range(0, g.size, 7), nodes, strict=True))


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_overlaps"])
def test_query_is_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM read_parquet('{TABLES}/{table}')")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, TABLES)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want.fetchall())


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_nearest_vectors_recall(spark):
    got = queries.QUERIES["op13_nearest_vectors"](spark, TABLES).collect()
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{TABLES}/embeddings.parquet").collect()]
    want = exact([r for r in rows if r[0] % 20 == 0], rows, 20)
    assert len(got) == 20 * len(want)
    assert sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got) >= 0.98 * len(got)
