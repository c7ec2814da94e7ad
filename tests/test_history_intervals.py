"""Histories and periods against brute force over small ranges, where every instant can be looked at."""

import random

import pytest
from pyspark.sql import functions as F

from kronoweft.operators import history, intervals, scans

FACTS = "subject bigint, predicate string, valid_from bigint, valid_to bigint, fact_id bigint, v string, cell string, t int"


def facts(n, seed, hot=False):
    rng, out = random.Random(seed), []
    for i in range(n):
        f = rng.choice([None, *range(0, 40)])
        t = rng.choice([None, None, *range(0, 45)])
        out.append((1 if hot else rng.choice([1, 2]), rng.choice(["a", "b"]), f, t, i, rng.choice(["x", "y", "z", None]), "c", 1))
    return out


def timeline(rows):
    out = []
    for k in sorted({r[:2] for r in rows}):
        at, last = {}, None
        mine = [r for r in rows if r[:2] == k and r[5] is not None]
        for s in range(0, 60):
            live = [r for r in mine if (r[2] or 0) <= s and (r[3] is None or s < r[3])]
            at[s] = max(live, key=lambda r: (r[2] or 0, r[4]))[5] if live else None
        for s in range(0, 60):
            if at[s] != last:
                if last is not None:
                    out[-1] = (*out[-1][:4], s)
                if at[s] is not None:
                    out.append((*k, at[s], s, -1))
                last = at[s]
    return sorted(out)


@pytest.mark.parametrize("seed,most", [(0, 1), (1, 2), (2, 5), (3, 10), (4, 25), (5, 100)])
def test_history(spark, rows, seed, most):
    data = facts(60, seed, hot=seed % 2 == 1)
    df = spark.createDataFrame(data + data[:10], FACTS).repartition(3)
    assert rows(history.type2_history(df, F.col("v"), most=most)) == timeline(data)


def test_history_without_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr(scans, "MOST_BOUNDS", 1)
    monkeypatch.setattr(history, "MOST_BOUNDS", 1)
    data = facts(60, 9)
    assert rows(history.type2_history(spark.createDataFrame(data, FACTS), F.col("v"), most=5)) == timeline(data)


def test_history_odd(spark, rows):
    odd = [(None, "a", 1, 2, 1, "x", "", 0), (1, None, 1, 2, 2, "x", "", 0), (1, "a", 5, 5, 3, "x", "", 0), (1, "a", 7, 3, 4, "x", "", 0), (1, "a", 1, 2, 5, None, "", 0)]
    assert rows(history.type2_history(spark.createDataFrame(odd, FACTS), F.col("v"))) == []
    assert rows(history.type2_history(spark.createDataFrame([], FACTS), F.col("v"))) == []


def test_merge_type2(spark, rows):
    dim = spark.createDataFrame([(1, "a", None, 0, -1), (2, "b", "q", 0, 5), (2, "c", "q", 5, -1), (3, "d", None, 0, -1), (4, "e", "z", 10, -1)], "k bigint, x string, y string, valid_from bigint, valid_to bigint")
    snap = spark.createDataFrame([(1, "a", None), (2, "c2", "q"), (2, "c1", "q"), (4, "f", "z"), (5, None, None)], "k bigint, x string, y string")
    got = rows(history.merge_type2(dim, snap, ["k"], ["x", "y"], 10))
    assert sorted(got, key=str) == sorted([(1, "a", None, 0, -1), (2, "b", "q", 0, 5), (2, "c", "q", 5, 10), (2, "c2", "q", 10, -1), (3, "d", None, 0, 10), (4, "f", "z", 10, -1), (5, None, None, 10, -1)], key=str)
    same = history.merge_type2(history.merge_type2(dim, snap, ["k"], ["x", "y"], 10), snap, ["k"], ["x", "y"], 20)
    assert sorted(rows(same), key=str) == sorted(got, key=str)


SEGS = "segment_id bigint, subject bigint, valid_from bigint, valid_to bigint, kind string, entity int"


def periods(data):
    out = []
    for s in sorted({r[1] for r in data if r[1] is not None}):
        merged = []
        for f, t in sorted((r[2] or 0, 10**18 if r[3] is None else r[3]) for r in data if r[1] == s):
            if f >= t:
                continue
            if merged and f <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], t)
            else:
                merged.append([f, t])
        out += [(s, "period", f, -1 if t == 10**18 else t) for f, t in merged]
        out += [(s, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out)


@pytest.mark.parametrize("seed,most,block", [(0, 1, 5), (1, 2, 200_000), (2, 8, 7), (3, 30, 16), (4, None, 200_000), (5, None, 3)])
def test_periods(spark, rows, seed, most, block, monkeypatch):
    monkeypatch.setattr(intervals._blocks, "__defaults__", (block,))
    rng = random.Random(seed)
    data = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(-20, 300, 5)]), None, "k", 1) for i in range(80)]
    data = [(*r[:3], None if rng.random() < 0.02 else (r[2] or 0) + rng.randrange(-3, 9), *r[4:]) for r in data]
    df = spark.createDataFrame(data + data[:7], SEGS)
    assert rows(intervals.periods_and_gaps(df, most=most)) == periods(data)


def test_periods_empty(spark, rows):
    assert rows(intervals.periods_and_gaps(spark.createDataFrame([], SEGS))) == []
    assert rows(intervals.periods_and_gaps(spark.createDataFrame([(1, 1, None, None, "", 0), (2, None, 1, 2, "", 0)], SEGS))) == [(1, "period", 0, -1)]
