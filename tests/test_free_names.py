"""Free names, running sums and clashing plans against the row-by-row way."""

from __future__ import annotations

import random

import pytest

from weir.operators import intervals, plans, running, spread
from weir.operators.free_names import free_names
from weir.sources import sinks


@pytest.fixture(autouse=True)
def all_is_heavy(monkeypatch):
    monkeypatch.setattr(spread, "LIGHT", 2)


def one_by_one(rows, there):
    used, out = {b.lower() for b in there}, {}
    for seq, base in sorted(rows):
        name, n = base, 2
        while name.lower() in used:
            name, n = f"{base} ({n})", n + 1
        used.add(name.lower())
        out[seq] = name
    return out


def some_base(rnd: random.Random) -> str:
    """Names of few families, with numbers behind numbers, some of which no copy gets."""
    return rnd.choice(["a", "A", "b"]) + "".join(f" ({rnd.choice([1, 2, 2, 3, 3, 4, 5, 6, '02'])})" for _ in range(rnd.choice([0, 0, 0, 1, 1, 2, 3])))


@pytest.mark.parametrize("seed", range(6))
def test_free_names_are_those_of_the_row_by_row_way(spark, seed):
    rnd = random.Random(seed)
    rows = [(k, some_base(rnd)) for k in rnd.sample(range(1000), (4, 40, 150)[seed % 3])]
    there = [some_base(rnd) for _ in range(seed % 4 * 3)]
    got = free_names(spark.createDataFrame(rows, "seq int, base string"), there=spark.createDataFrame([(x,) for x in there], "base string"))
    assert {r.seq: r.name for r in got.collect()} == one_by_one(rows, there)


def test_numbers_reached_before_their_literals(spark):
    """A thousand copies come first, then the numbers as names of their own: the low ones are taken, the high ones keep theirs."""
    rows = [(k, "a") for k in range(300)] + [(1000 + n, f"a ({n})") for n in range(2, 500)] + [(5000 + k, "a") for k in range(20)]
    got = free_names(spark.createDataFrame(rows, "seq long, base string"))
    assert {r.seq: r.name for r in got.collect()} == one_by_one(rows, [])


def test_free_names_by_key_with_odd_rows(spark):
    rows = [(1, "a", "x", 7), (2, "a", "y", 7), (3, "A", "x", 8), (4, None, "x", 9), (5, None, None, 9), (6, "", "x", 9), (7, "é\n", "x", 1), (8, "É\n", "x", 1)]
    got = free_names(spark.createDataFrame(rows, "seq int, base string, folder string, _at int"), ["folder"])
    assert got.columns == ["seq", "base", "folder", "_at", "name"]
    assert {r.seq: r.name for r in got.collect()} == {1: "a", 2: "a", 3: "A (2)", 4: "", 5: "", 6: " (2)", 7: "é\n", 8: "É\n (2)"}
    assert free_names(spark.createDataFrame([], "seq int, base string")).count() == 0


def test_output_names(spark):
    there = spark.createDataFrame([("b",), ("b (5)",), ("A.txt",), ("c (2).txt",), (".x",)], "name string")
    plan = [(1, "b"), (2, "a.txt"), (3, "a.txt"), (4, "c.txt"), (5, "c.txt"), (6, "new.tar.gz"), (7, ".x"), (8, "b")]
    got = {r.seq: r.output for r in sinks.numbered_outputs(spark.createDataFrame(plan, "seq int, name string"), there).collect()}
    assert got == {1: "b (2)", 2: "a (2).txt", 3: "a (3).txt", 4: "c.txt", 5: "c (3).txt", 6: "new.tar.gz", 7: ".x (2)", 8: "b (3)"}


def test_running_sums_of_a_hot_group(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot", "hot", "x", "y"]), k, rnd.randint(-3, 9)) for k in rnd.sample(range(5000), 2000)]
    got = running.prefix_sum(spark.createDataFrame(rows, "g string, at int, v int").repartition(7), ["g"], ["at"], "v", "before").collect()
    so_far, want = {}, {}
    for g, at, v in sorted(rows, key=lambda r: r[1]):
        want[at] = so_far.get(g, 0)
        so_far[g] = so_far.get(g, 0) + v
    assert {r["at"]: r.before for r in got} == want and len(got) == len(rows)


def test_clashes_of_a_hot_name(spark):
    rows = [(k, "P", f"n{k}", "same" if k % 3 else f"only{k}") for k in range(90)] + [(100, "p", "n100", "SAME"), (101, "p", "n101", None), (102, None, "n102", None)]
    got = {r.seq: r.problem for r in plans.clashes(spark.createDataFrame(rows, "seq int, parent string, name string, new_name string").repartition(4)).collect()}
    assert got == {k: "" if new is None or new.startswith("only") else "Same new name as 'n2'" if k == 1 else "Same new name as 'n1'" for k, _, _, new in rows}


def test_pages_of_all_inputs(spark):
    listing = [(q, p, q != 2) for q in range(5) for p in range(q * 10)]
    got = sorted((r.place, r.queue, r.page) for r in intervals.concatenated(spark.createDataFrame(listing, "queue int, page int, ok boolean").repartition(5)).collect())
    want = [(q, p) for q, p, ok in listing if ok]
    assert got == [(k, q, p) for k, (q, p) in enumerate(want, 1)]
