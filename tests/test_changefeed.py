"""Current state from a change feed: against a plain fold, in any order, in batches, and with defined odd cases."""

import random

import pytest

from kronoweft.operators import changefeed

SCHEMA = "feed_id bigint, tx bigint, source int, seq bigint, kind string, subject bigint, predicate string, object_node bigint, object_int bigint, object_text string, observed array<bigint>, salt int, floor string"


def feed(n, seed):
    rng, out = random.Random(seed), []
    adds = []
    for seq in range(n):
        kind = rng.choice(["SetOne", "SetOne", "CloseOne", "AddMany", "AddMany", "CloseMany", "RemoveMany", "HardDelete", "SetEdgeProp"])
        s, p = rng.choice([1, 2]), rng.choice(["a", "b"])
        obj = [None, None, None]
        if kind in ("SetOne", "AddMany", "CloseMany", "SetEdgeProp"):
            obj[rng.randrange(3)] = rng.choice([1, 2])
            obj[2] = None if obj[2] is None else f"t{obj[2]}"
        seen = [x for x, k in adds if k == (s, p)]
        observed = rng.sample(seen, min(len(seen), rng.randrange(3))) if kind == "RemoveMany" else None
        if kind == "AddMany":
            adds.append((seq, (s, p)))
        if kind == "HardDelete" and rng.random() < 0.6:
            continue
        out.append((seq, rng.randrange(8), rng.choice([0, 1, 2, None]), seq, kind, s, p, *obj, observed, 7, "x"))
    return out


def text(r):
    return f"node:{r[7]}" if r[7] is not None else f"int:{r[8]}" if r[8] is not None else f"text:{r[9]}" if r[9] is not None else None


def brute(rows):
    key = lambda r: (r[1], r[2] or 0, r[3])
    floor = {}
    for r in rows:
        if r[4] == "HardDelete":
            floor[r[5], r[6]] = max(floor.get((r[5], r[6]), (-1,)), key(r))
    live = [r for r in rows if key(r) > floor.get((r[5], r[6]), (-1,))]
    gone = {(r[5], r[6], x) for r in live if r[4] == "RemoveMany" for x in r[10] or []}
    best = {}
    for r in live:
        if r[4] in ("SetOne", "CloseOne"):
            k = (r[5], r[6], None)
        elif r[4] == "CloseMany" or r[4] == "AddMany" and (r[5], r[6], r[3]) not in gone:
            k = (r[5], r[6], text(r))
        else:
            continue
        if k not in best or key(r) > key(best[k]):
            best[k] = r
    return sorted((k[0], k[1], text(r), r[3]) for k, r in best.items() if r[4] in ("SetOne", "AddMany") and text(r))


@pytest.mark.parametrize("seed", range(2))
def test_any_order_copies_and_batches(spark, rows, seed):
    data = feed(60, seed)
    again = data + random.Random(seed).sample(data, 20)
    random.Random(seed + 1).shuffle(again)
    df = spark.createDataFrame(again, SCHEMA)
    assert rows(changefeed.current_values(df)) == brute(data)
    a, b = spark.createDataFrame(again[:30], SCHEMA), spark.createDataFrame(again[30:], SCHEMA)
    assert rows(changefeed.current_values(b, base=changefeed.compact(a))) == brute(data)
    once = changefeed.compact(df)
    assert changefeed.compact(once).count() == once.count()


def test_late_add_stays_removed(spark, rows):
    remove = [(1, 5, 1, 2, "RemoveMany", 1, "p", None, None, None, [1], 0, "")]
    add = [(2, 1, 1, 1, "AddMany", 1, "p", 9, None, None, None, 0, "")]
    base = changefeed.compact(spark.createDataFrame(remove, SCHEMA))
    assert rows(changefeed.current_values(spark.createDataFrame(add, SCHEMA), base=base)) == []


def test_odd_rows(spark, rows):
    odd = [
        (1, 1, 1, 1, "SetOne", None, "p", 1, None, None, None, 0, ""), (2, 1, 1, 2, "SetOne", 1, None, 1, None, None, None, 0, ""),
        (3, 1, 1, 3, "AddMany", 1, "p", None, None, None, None, 0, ""), (4, 1, 1, 4, "Other", 1, "p", 1, None, None, None, 0, ""),
        (5, 1, 1, 5, None, 1, "p", 1, None, None, None, 0, ""), (6, None, None, 6, "SetOne", 1, "q", None, None, "", None, 0, ""),
        (7, 2, 1, 7, "SetOne", 2, "q", None, None, None, None, 0, ""), (8, 1, 1, 8, "RemoveMany", 1, "p", None, None, None, None, 0, ""),
        (9, 1, 1, 9, "SetOne", 3, "x" * 9000, None, None, "y" * 90000, None, 0, ""),
    ]
    got = rows(changefeed.current_values(spark.createDataFrame(odd, SCHEMA)))
    assert got == [(1, "q", "text:", 6), (3, "x" * 9000, "text:" + "y" * 90000, 9)]
    assert rows(changefeed.current_values(spark.createDataFrame([], SCHEMA))) == []
    assert rows(changefeed.compact(spark.createDataFrame([], SCHEMA))) == []
