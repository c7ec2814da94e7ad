import datetime as dt
import random

import pytest

from kronoweft.operators import orphans, widen

T0 = dt.datetime(2024, 1, 1)
REFS = "fact_id bigint, object_node bigint, arrived_at timestamp_ntz, node string, at string"
NODES = "node_seq bigint, id bigint, op string, arrived_at timestamp_ntz, first int"


def brute(refs, nodes):
    out = []
    for i, n, at, *_ in refs:
        mine = sorted(((x[3], x[0], x[2]) for x in nodes if x[1] == n and x[3] is not None))
        if n is None:
            continue
        if not any(x[1] == n and x[2] == "declare" for x in nodes):
            why = "missing"
        elif at is None:
            continue
        else:
            before = [x for x in mine if x[0] <= at]
            why = "late" if not before and mine else "deleted" if before and before[-1][2] == "drop" else None
        if why:
            out.append(("fact_rows", at.strftime("%Y-%m") if at else None, i, why))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,heavy,most", [(0, 50_000, None), (1, 5, 5), (2, 1, 1), (3, 5, 2)])
def test_orphans(spark, rows, seed, heavy, most):
    rng = random.Random(seed)
    when = lambda: T0 + dt.timedelta(hours=rng.randrange(0, 2000, 7))
    nodes = [(i, rng.choice([1, 1, 1, 2, 3, 4]), rng.choice(["declare", "declare", "drop"]), when(), 0) for i in range(40)]
    nodes = [r if not (r[1] == 4) else (*r[:2], "drop", *r[3:]) for r in nodes]
    refs = [(i, rng.choice([None, 1, 1, 1, 2, 3, 4, 5, 5, 5, 5]), rng.choice([None, when(), when(), when(), when()]), "x", "y") for i in range(120)]
    r = orphans.references(spark.createDataFrame(refs, REFS), "fact_rows", "fact_id", "object_node")
    got = orphans.orphans(r, spark.createDataFrame(nodes + nodes[:5], NODES), heavy=heavy, most=most)
    assert sorted(rows(got), key=str) == brute(refs, nodes)


def test_orphans_empty_sides(spark, rows):
    refs, nodes = spark.createDataFrame([(1, 9, T0, "", "")], REFS), spark.createDataFrame([], NODES)
    of = lambda r: orphans.references(r, "t", "fact_id", "object_node")
    assert rows(orphans.orphans(of(refs), nodes)) == [("t", "2024-01", 1, "missing")]
    assert rows(orphans.orphans(of(refs.limit(0)), nodes)) == []
    assert rows(orphans.orphan_report(orphans.orphans(of(refs), nodes, most_broadcast=-1))) == [("t", "2024-01", "missing", 1)]


FACTS = "fact_id bigint, subject bigint, predicate string, object_node bigint, object_int bigint, object_float double, object_text string, valid_from bigint, __best string"
ATTRS = [widen.Attribute("title", "title", "text"), widen.Attribute("issue-type", "issue_type", "text"), widen.Attribute("priority", "priority", "int"), widen.Attribute("approved-at", "approved_at", "instant")]


def fact(i, s, p, *, node=None, n=None, f=None, t=None, vf=None):
    return (i, s, p, node, n, f, t, vf, "b")


@pytest.mark.parametrize("block", [1, 2, 64])
def test_widen(spark, rows, block):
    data = [
        fact(1, 1, "title", t=" old ", vf=5), fact(2, 1, " TITLE", t="new\t", vf=5), fact(3, 1, "title", t="  ", vf=9), fact(4, 1, "Issue Type", n=7), fact(5, 1, "priority", t="+0003"),
        fact(6, 1, "priority", t="high", vf=99), fact(7, 1, "priority", f=4.5, vf=98), fact(8, 1, "priority", f=float("nan"), vf=97), fact(9, 1, "other", t="x"),
        fact(10, 2, "priority", t="tbd"), fact(11, 3, "approved_at", t="2024/02/27 22:07:53 "), fact(12, 4, "approved-at", f=1.7e9), fact(13, 4, "title", t=" é "),
        fact(14, None, "title", t="x"), fact(15, 5, "nothing", t="x"), fact(16, 6, "priority", t="5.0"), fact(17, 7, "title", t="z" * 100_000), fact(18, 8, "approved at", t="2024-13-45 00:00:00"),
        fact(19, 9, "approved-at", t="2024-01-01T00:00:00Z"),
    ]
    got = {r[0]: r[1:] for r in rows(widen.wide(spark.createDataFrame(data + data[:3], FACTS), ATTRS, block=block))}
    assert got == {
        1: ("new", "7", 3, -1), 2: ("", "", -1, -1), 3: ("", "", -1, 1709071673), 4: ("é", "", -1, 1700000000), 6: ("", "", 5, -1), 7: ("z" * 100_000, "", -1, -1), 8: ("", "", -1, -1), 9: ("", "", -1, 1704067200),
    }
    assert rows(widen.wide(spark.createDataFrame([], FACTS), ATTRS, block=block)) == []


def test_blocks_share_one_shuffle(spark):
    df = widen.wide(spark.createDataFrame([fact(1, 1, "title", t="x")], FACTS), ATTRS, block=1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") == 3
