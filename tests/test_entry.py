"""The registry of queries, and the calendar, CSV and fold pieces that need no large tables."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kronoweft.functions import calendar
from kronoweft.model import OBJECT, object_text
from kronoweft.operators import fold, temporal
from kronoweft.operators.snapshot import Pipeline, Snapshot
from kronoweft.sources import csvfacts
from kronoweft.streaming import live

DATA = "/root/testdata/sf0.001"


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["subject", "predicate", "value", "valid_from", "valid_to"]


@pytest.mark.parametrize("name", ["p1_found", "p4_found", "p5_found", "p6_found", "p2_snapshots", "fold_retract", "point_many_asof", "expand_2hop", "csv_facts"])
def test_against_sql(spark, rows, name):
    c = duckdb.connect()
    for t in ("record_feed", "fact_rows", "node_rows", "vector_rows", "segment_rows", "pred_defs", "customer"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    cur = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, rows(df, *names))) == sorted(map(str, cur.fetchall()))


def test_pipeline_without_cap_keeps_the_order(spark):
    """Uncapped steps lead to the same order as capped ones, ties by id included."""
    log = spark.createDataFrame([(n, "AddMany", s, p, (0, o, None, None, None, None), 0, None, None, None) for n, (s, p, o) in enumerate([(1, "a", 12), (1, "a", 11), (2, "a", 10), (11, "b", 21), (12, "b", 20), (10, "b", 5), (3, "a", 9)])], LOG)
    s = Snapshot(log, spark.createDataFrame([(n, "T", None) for n in (1, 2, 3, 3)], "node long, type string, label int"))
    for most in (100, None):
        p = Pipeline(s, max_nodes=most).nodes(s.attrs).expand("a").expand("b")
        assert [r["id"] for r in p.df.orderBy("ord").collect()] == [21, 20, 5]
        assert [(r["id"], r["ord"]) for r in p.cap(2).df.orderBy("ord").collect()] == [(21, 1), (20, 2)]


def test_calendar(spark):
    """Against Python's own calendar, over instants before and after the epoch, offsets and starts of the fiscal year."""
    rng = random.Random(6)
    for _ in range(4):
        offset, start, as_of = rng.choice([-570, -60, 0, 345, 720]), rng.randrange(1, 13), rng.randrange(0, 2**31)
        instants = [rng.randrange(-(2**31), 2**32) for _ in range(20)]
        df = spark.createDataFrame([(t,) for t in instants], "t long")
        got = {r["t"]: r["x"] for r in df.select("t", calendar.tag(F.col("t"), F.lit(as_of), offset, start_month=start).alias("x")).collect()}
        local = lambda t: dt.datetime(1970, 1, 1) + dt.timedelta(seconds=t, minutes=offset)  # noqa: B023, E731
        for t in instants:
            d = local(t)
            days = (local(as_of).date() - d.date()).days
            where = "same day" if not days else f"{abs(days)} days {'before' if days > 0 else 'after'}"
            busy = ", business hours" if d.weekday() < 5 and 9 <= d.hour < 18 else ""
            zone = f"{'-' if offset < 0 else '+'}{abs(offset) // 60:02d}:{abs(offset) % 60:02d}"
            fiscal = f"FY{d.year - (d.month < start)} Q{(d.month - start) % 12 // 3 + 1}"
            assert got[t] == f"{d:%Y-%m-%d %H:%M} {zone} ({d:%a}, {where}{busy}, {fiscal})"


def test_floats_keep_their_digits(spark, rows):
    """Values that differ in the sixth place are different versions, and huge ones are values like others."""
    values = [0.00001, 0.00004, 7.123456, 7.1234561, 1e17, -2.5, 3.0, 123456789.25]
    log = spark.createDataFrame([(n, "SetOne", 1, "p", (2, None, None, v, None, None), 10 * n, None, None, None) for n, v in enumerate(values)], LOG)
    got = rows(temporal.timeline(fold.one_history(log)), "valid_from", "value")
    assert [(f, float(v[6:])) for f, v in got] == [(10 * n, v) for n, v in enumerate(values)] and got[-1][1] == "float:123456789.25"


def test_csv(spark, rows, tmp_path):
    (tmp_path / "t.csv").write_text('﻿id,title,n,boss,since,note\n1,"a ""quoted""\nline",3,2,2024-01-02,\n2,b,4.5,,2024/03/04 10:00,x\n,,,,,\n')
    df = csvfacts.read_csv(spark, str(tmp_path / "t.csv"))
    roles = {"id": csvfacts.Role("id"), "title": csvfacts.Role("literal"), "n": csvfacts.Role("literal"), "boss": csvfacts.Role("edge", "W"), "since": csvfacts.Role("valid_from"), "note": csvfacts.Role("literal")}
    got = rows(csvfacts.compile_facts(df, "W", roles).withColumn("object", object_text("object")), "predicate", "object", "valid_from")
    two = csvfacts.compile_facts(df, "W", roles).where("predicate = 'title'").select("subject").collect()
    assert [g for g in got if g[0] != "boss"] == [("n", "float:3.0", 1704153600), ("n", "float:4.5", 1709546400), ("note", "text:x", 1709546400), ("title", 'text:a "quoted"\nline', 1704153600), ("title", "text:b", 1709546400)]
    assert int([g for g in got if g[0] == "boss"][0][1][5:]) in {r[0] for r in two}
    with pytest.raises(Exception, match="blank id"):
        csvfacts.compile_facts(spark.createDataFrame([(" ", "x")], "id string, title string"), "W", {k: roles[k] for k in ("id", "title")}).collect()


LOG = f"ok bigint, op string, subject bigint, predicate string, object {OBJECT}, valid_from bigint, valid_to bigint, source string, observed array<bigint>"


def change(ok, op, value=None, vf=0, vt=None, seen=None):
    return (ok, op, 1, "p", None if value is None else (1, None, value, None, None, None), vf, vt, None, seen)


def test_late_fact_takes_the_head_and_history_is_resliced(spark, rows):
    log = spark.createDataFrame([change(1, "SetOne", 10, 100), change(2, "CloseOne", None, 300), change(3, "SetOne", 7, 50, 80)], LOG)
    head = fold.one(log).first()
    assert (head["object"]["i"], head["valid_to"]) == (7, 80)  # current is the last change, whatever its valid time
    assert rows(temporal.timeline(fold.one_history(log)), "value", "valid_from", "valid_to") == [("int:10", 100, 300), ("int:7", 50, 80)]
    for at, want in [(40, None), (60, 7), (90, None), (100, 10), (299, 10), (300, None)]:
        got = temporal.asof_one(fold.one_history(log), at).first()
        assert (got["object"]["i"] if got else None) == want
    gc = fold.collect_garbage(fold.merge(log, spark.createDataFrame([change(4, "AddMany", 1), change(5, "RemoveMany", seen=[4]), change(6, "HardDelete")], LOG)))
    assert rows(gc, "ok", "op") == [(6, "HardDelete")]


def test_stream_equals_batch(spark, rows, tmp_path):
    feed = spark.read.parquet(f"{DATA}/record_feed.parquet")
    feed.repartition(6).write.parquet(str(tmp_path / "feed"))
    got = live.stream_current_values(spark, str(tmp_path / "feed"), files_per_batch=2)
    assert rows(got) == rows(entry.queries()["p1_found"](spark, DATA))


def test_stream_goes_on_after_a_restart(spark, rows, tmp_path):
    """Half of the feed, a new state on the same folder, the other half; and a batch that is delivered twice."""
    spark.read.parquet(f"{DATA}/record_feed.parquet").repartition(4).write.parquet(str(tmp_path / "feed"))
    files = sorted((tmp_path / "feed").glob("part-*"))
    first, folder = tmp_path / "in", f"file://{tmp_path}/fold"
    first.mkdir()
    for half in (files[:2], files[2:]):
        for f in half:
            f.rename(first / f.name)
        state = live.FoldedState(spark, folder, buckets=3)
        live.fold_stream(live.read_feed(spark, str(first), 1), state).awaitTermination()
    assert state.batch == 3 and rows(state.current()) == rows(entry.queries()["p1_found"](spark, DATA))
    again = live.FoldedState(spark, folder)
    assert (again.batch, again.buckets, again.paths) == (state.batch, 3, state.paths)
    again.apply(spark.read.parquet(str(first)).limit(5), 3)
    assert rows(again.current()) == rows(state.current())
    # only the tables of the last two states are left
    assert len(list((tmp_path / "fold" / "tables").iterdir())) <= 6 and len(list((tmp_path / "fold" / "state").glob("batch-*"))) == 2
    # a batch that touches one key rewrites one bucket
    before = dict(again.paths)
    again.apply(spark.read.parquet(f"{DATA}/record_feed.parquet").where("subject IS NOT NULL AND predicate IS NOT NULL").limit(1), 4)
    assert sum(before.get(k) != v for k, v in again.paths.items()) == 1 and rows(again.current()) == rows(state.current())
    assert rows(live.FoldedState(spark, f"file://{tmp_path}/none").current()) == []


def test_live_queries(spark):
    state = {"df": spark.createDataFrame([(1,), (2,)], "x int")}
    told = []
    q = live.LiveQueries(most=1)
    n = q.register(lambda: state["df"], lambda added, removed: told.append((added.collect(), removed.collect())))
    with pytest.raises(RuntimeError):
        q.register(lambda: state["df"], print)
    assert q.changed() == 0
    state["df"] = spark.createDataFrame([(2,), (3,)], "x int")
    assert q.changed() == 1 and [[r[0] for r in part] for part in told[0]] == [[3], [1]]
    assert q.deregister(n) and not q.deregister(n)
