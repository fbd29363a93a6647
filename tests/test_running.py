"""Steps that are followed through ranges, and paragraphs of keys that are never gathered."""

from __future__ import annotations

import random

import pytest

from weir.operators import intervals, running


def test_visited_rows(spark):
    rnd = random.Random(1)
    rows, want = [], set()
    for group, n in ((1, 3000), (2, 1), (-3, 40), (4, 700)):
        step = {k: min(k + rnd.randint(1, rnd.choice([2, 5, 400])), n) for k in range(n)}
        rows += [(group, k, running.END if s == n else s) for k, s in step.items()]
        at = 0
        while at < n:
            want.add((group, at))
            at = step[at]
    got = running.visited(spark.createDataFrame(rows, "_group long, at long, step long").repartition(3)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_next_least(spark):
    rnd = random.Random(2)
    rows = [(g, k, rnd.choice([None, None, k, k + 3])) for g in "ab" for k in rnd.sample(range(900), 500)]
    got = running.next_least(spark.createDataFrame(rows, "g string, at long, v long").repartition(3), ["g"], ["at"], "v", "least").collect()
    for r in got[::7]:
        assert r.least == min((v for g, k, v in rows if g == r.g and k >= r["at"] and v is not None), default=None)


def spoken(seed: int) -> list[tuple]:
    rnd = random.Random(seed)
    out = []
    for key, n in (("long", 900), ("short", 1), (None, 60), ("noend", 80)):
        clock = 0.0
        for seq in rnd.sample(range(5000), n) and sorted(rnd.sample(range(5000), n)):
            text = "w" * rnd.randint(0, 60) + (rnd.choice(["", "", ".", "!", "?", "…", ".\n"]) if key != "noend" else "")
            start, clock = clock, clock + 1
            out.append((key, seq, start, clock, rnd.choice([text, text, text, None]) if seed else text))
            clock += rnd.choice([0, 0.5, 1.5, 1.5, 1.5, 1.6] if rnd.random() < 0.1 else [0])
    rnd.shuffle(out)
    return out


def paragraphs(rows) -> set:
    out = set()
    for key in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == key))
        now, n = [], 0
        for k, (_, _, end, text) in enumerate(mine):
            now.append(text or "")
            pause = k + 1 < len(mine) and mine[k + 1][1] - end > 1.5
            if pause or ((text or "").endswith((".", "!", "?", "…")) and len(" ".join(now)) > 280):
                out.add((key, n, " ".join(now)))
                now, n = [], n + 1
        if now:
            out.add((key, n, " ".join(now)))
    return out


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("most", [0, 10_000])
def test_paragraphs_either_way(spark, seed, most):
    rows = spoken(seed)
    df = spark.createDataFrame(rows, "key string, seq long, start double, end double, text string").repartition(3)
    got = [tuple(r) for r in intervals.transcript_paragraphs(df, most=most).collect()]
    assert len(got) == len(set(got)) and set(got) == paragraphs(rows)


def test_paragraphs_by_ranges_write_one_table(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter

    written, parquet = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: written.append(path) or parquet(self, path, *a, **b))
    rows = spoken(2)
    df = spark.createDataFrame(rows, "key string, seq long, start double, end double, text string").repartition(3)
    got = [tuple(r) for r in intervals.transcript_paragraphs(df, longest=280, most=0).collect()]
    assert len(written) == 1 and len(got) == len(set(got)) and set(got) == paragraphs(rows)
