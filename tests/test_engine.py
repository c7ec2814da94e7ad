"""The engine's operations over a store of voyages, berths and pilots, judged against plain loops over the same lines."""

import json
import random

import pytest

from kronoweft.api import Engine
from kronoweft.sources.store import Store

ZONES, BERTHS, PILOTS, VOYAGES = range(1, 4), range(11, 16), range(21, 27), range(31, 47)
ONE = {"called": "Pilot", "berth": "Voyage", "zone": "Berth", "rostered": "Zone", "piloted": "Voyage", "sailed": "Voyage", "cargo": "Voyage", "phase": "Voyage", "remark": "Voyage"}
DEFS = [{"type_def": {"name": t}} for t in ("Zone", "Berth", "Pilot", "Voyage")]
DEFS += [{"pred_def": {"name": p, "cardinality": "one", "domain": d, "display": p == "remark"}} for p, d in ONE.items()]
DEFS += [{"pred_def": {"name": "crew", "domain": "Voyage", "range": "Pilot"}}, {"pred_def": {"name": "buddy", "range": "Pilot", "symmetric": True}}, {"pred_def": {"name": "feeds", "range": "Zone", "transitive": True}}]
RULE = {"subject": "Voyage", "scope": {"predicate": "cargo", "equals": "oil"}, "required": ["berth", "zone", {"predicate": "rostered", "as_of": "sailed"}], "actual": "piloted", "absent_when": {"predicate": "phase", "equals": "moored"}}
DEFS.append({"rule_def": {"name": "pilotage", "rule": RULE}})
HIDDEN = 26  # a pilot with label 5


def text(lines):
    return "\n".join(map(json.dumps, lines))


def fact(s, p, o, **more):
    kind = o if isinstance(o, dict) else {"text": o} if isinstance(o, str) else {"node": o}
    return {"fact": {"subject": s, "predicate": p, "object": kind, **more}}


def lines_of(rng, n):
    """Random facts and closes; no two in a row say the same, so none is left out as a copy."""
    out = []
    for _ in range(n):
        span = {"valid_from": rng.randrange(1000)} | ({"valid_to": rng.randrange(1000, 1400)} if rng.random() < 0.2 else {})
        v = rng.choice(VOYAGES)
        out.append(rng.choice([
            lambda: fact(rng.choice(BERTHS), "zone", rng.choice(ZONES)), lambda: fact(rng.choice(ZONES), "rostered", rng.choice(PILOTS[:-1]), **span), lambda: fact(rng.choice(ZONES), "rostered", rng.choice(PILOTS[:-1]), **span),
            lambda: fact(v, "berth", rng.choice(BERTHS)), lambda: fact(v, "piloted", rng.choice(PILOTS[:-1])), lambda: fact(v, "sailed", {"int": rng.randrange(1200)}),
            lambda: fact(v, "cargo", rng.choice(["oil", "oil", "grain"])), lambda: fact(v, "phase", rng.choice(["moored", "at sea"])),
            lambda: fact(v, "crew", rng.choice(PILOTS[:-1]), **span), lambda: {"close": {"subject": v, "predicate": "crew", "object": {"node": rng.choice(PILOTS[:-1])}, "valid_from": rng.randrange(1000)}},
            lambda: {"close": {"subject": v, "predicate": "piloted", "valid_from": rng.randrange(1000)}},
        ])())
    return out


class Plain:
    """The same answers from loops over the lines, in the order in which they were written."""

    def __init__(self):
        self.rows = []

    def take(self, lines):
        for x in lines:
            kind = next(iter(x))
            f = x[kind]
            o = f.get("object")
            if kind in ("fact", "close"):
                self.rows.append((f["subject"], f["predicate"], next(iter(o.values())) if o else None, f.get("valid_from", 0), f.get("valid_to") if kind == "fact" else None, kind == "fact"))

    def of(self, s, p):
        return [(n, *r[2:]) for n, r in enumerate(self.rows) if r[:2] == (s, p)]

    def now(self, s, p):
        mine = self.of(s, p)
        return mine[-1][1] if mine and mine[-1][4] else None

    def at(self, s, p, t):
        live = [(vf, n, o, put) for n, o, vf, vt, put in self.of(s, p) if vf <= t and (vt is None or t < vt)]
        return max(live)[2] if live and max(live)[3] else None

    def crew_at(self, v, t):
        return sorted(o for o in PILOTS if (live := [(vf, n, put) for n, x, vf, vt, put in self.of(v, "crew") if x == o and vf <= t and (vt is None or t < vt)]) and max(live)[2])

    def verdict(self, v):
        if self.now(v, "cargo") != "oil":
            return "NOT_APPLICABLE", None
        actual = self.now(v, "piloted")
        if actual is None:
            return ("ABSENT" if self.now(v, "phase") == "moored" else "OK"), None
        zone, t = self.now(self.now(v, "berth"), "zone"), self.now(v, "sailed")
        if zone is not None and t is not None and self.at(zone, "rostered", t) == actual:
            return "OK", None
        return "MISMATCH", "stale" if zone is not None and any(o == actual for _, o, *_ in self.of(zone, "rostered")) else "wrong"


@pytest.fixture(scope="module")
def harbour(spark, tmp_path_factory):
    e, plain = Engine(Store(spark, f"file://{tmp_path_factory.mktemp('harbour')}")), Plain()
    e.ingest(text(DEFS))
    lines = [{"node": {"id": i, "type": t}} for t, ids in (("Zone", ZONES), ("Berth", BERTHS), ("Pilot", PILOTS), ("Voyage", VOYAGES)) for i in ids] + [{"node": {"id": HIDDEN, "label": 5}}]
    lines += [fact(21, "called", "Ines", source="logbook"), fact(21, "called", "Ines", source="radio"), fact(22, "called", "Olav", source="logbook", valid_from=300)]
    lines += [fact(21, "buddy", 22), fact(23, "buddy", 21), fact(21, "buddy", HIDDEN), fact(1, "feeds", 2), fact(2, "feeds", 3), fact(3, "feeds", 2)]
    lines += [fact(31 + i, "remark", f"Voyage {i}, ice near the Breakwater" if i % 2 else f"Voyage {i}") for i in range(16)]
    lines += [fact(31, "crew", 24, props={"post": "stern", "years": 4, "armed": {"bool": False}}), *lines_of(random.Random(11), 420)]
    e.ingest(text(lines), source="import")
    plain.take(lines)
    e.embed(text([{"node": 31 + i, "vector": [float(i), 2.0, 0.0]} for i in range(16)]))
    return e, plain


def test_current_and_as_of(harbour):
    e, plain = harbour
    rng = random.Random(4)
    for _ in range(8):
        z, t, v = rng.choice(ZONES), rng.randrange(1500), rng.choice(VOYAGES)
        at = plain.at(z, "rostered", t)
        assert e.query({"op": "point", "subject": z, "predicate": "rostered", "valid_at": t}) == {"one": None if at is None else {"node": at}, "valid_at": t}
        assert e.query({"op": "point", "subject": v, "predicate": "crew", "valid_at": t})["many"] == [{"node": n} for n in plain.crew_at(v, t)]
        now = plain.now(v, "cargo")
        assert e.query({"op": "point", "subject": v, "predicate": "cargo"})["one"] == (now and {"text": now})


def test_confidence_and_scope(harbour):
    e, _ = harbour
    assert e.query({"op": "point", "subject": 21, "predicate": "called"}) == {"one": {"text": "Ines"}, "valid_from": 0, "confidence": {"tier": "high", "corroboration": 2, "age": None}, "provenance": "radio"}
    assert e.query({"op": "point", "subject": 22, "predicate": "called", "now": 1000, "max_age": 600})["confidence"] == {"tier": "low", "corroboration": 1, "age": 700}
    assert e.query({"op": "point", "subject": HIDDEN, "predicate": "called", "allowed_labels": 3}) == {"denied": True}
    with pytest.raises(ValueError, match="unknown predicate"):
        e.query({"op": "point", "subject": 1, "predicate": "tonnage"})


def test_expand_and_timeline(harbour):
    e, plain = harbour
    ask = lambda s, p, **k: e.query({"op": "expand", "subject": s, "predicate": p, **k}).get("nodes")
    assert ask(21, "buddy") == [22, 23, HIDDEN] and ask(21, "buddy", allowed_labels=3) == [22, 23]
    assert ask(1, "feeds") == [2, 3] and ask(1, "feeds", max_depth=1) == [2] and ask(2, "feeds") == [2, 3]
    berth = next(b for b in BERTHS if plain.now(b, "zone"))
    got = e.query({"op": "timeline", "subject": berth, "hops": ["zone", "rostered"]})["segments"]
    for t in range(0, 1500, 7):
        zone = plain.at(berth, "zone", t)
        want = plain.at(zone, "rostered", t) if zone else None
        assert [s["value"]["node"] for s in got if s["valid_from"] <= t and (s["valid_to"] is None or t < s["valid_to"])] == ([want] if want else [])
    assert e.query({"op": "edge_props", "subject": 31, "predicate": "crew", "object": 24})["props"] == {"post": {"text": "stern"}, "years": {"int": 4}, "armed": {"bool": False}}


def test_views(harbour):
    e, plain = harbour
    missing = {v: [p for p in ("berth", "piloted") if plain.now(v, p) is None] for v in VOYAGES}
    assert e.query({"op": "completeness", "type": "Voyage", "required": ["berth", "piloted"]})["incomplete"] == [{"node": v, "missing": m} for v, m in missing.items() if m]
    found = e.query({"op": "find", "text": "breakWATER", "limit": 3})
    assert [n["id"] for n in found["nodes"]] == [32, 34, 36] and found["truncated"] and found["nodes"][0]["name"] == "Voyage 1, ice near the Breakwater"
    assert not e.query({"op": "find", "text": "breakwater", "limit": 8})["truncated"]
    near = e.query({"op": "neighborhood", "subject": 21, "hops": 1, "predicate": "buddy", "allowed_labels": 3})
    assert [(n["id"], n["depth"]) for n in near["nodes"]] == [(21, 0), (22, 1), (23, 1)] and near["edges"] == [[21, 22, 1], [21, 23, 1]]
    told = e.query({"op": "node", "subject": 21})
    assert told["props"]["called"] == {"one": {"text": "Ines"}, "source": "radio", "tier": "high"} and (told["type"], told["label"], told["embedding"]) == ("Pilot", None, False)
    assert e.query({"op": "node", "subject": 33})["embedding"] and e.query({"op": "node", "subject": HIDDEN})["label"] == 5
    assert {t["name"]: t["count"] for t in e.query({"op": "overview"})["nodes"]} == {"Berth": 5, "Pilot": 6, "Voyage": 16, "Zone": 3}
    assert e.query({"op": "graph", "max_nodes": 3})["truncated"] and not e.query({"op": "graph"})["truncated"]
    schema = e.query({"op": "schema"})
    assert schema["rules"] == ["pilotage"] and schema["labels"] == [5] and len(schema["predicates"]) == 12


def test_search(harbour):
    e, plain = harbour
    assert e.query({"op": "search", "type": "Voyage", "vector": [3.4, 2.0, 0.0], "k": 2})["ids"] == [34, 35]
    want = [b for v in (31, 32) if (b := plain.now(v, "berth"))]
    assert e.query({"op": "search", "type": "Voyage", "vector": [0.0, 2.0, 0.0], "k": 2, "expand": "berth"})["ids"] == list(dict.fromkeys(want))
    got = e.query({"op": "retrieve_context", "type": "Voyage", "vector": [0.0, 2.0, 0.0], "k": 4, "content": "remark", "date": "sailed"})
    dated = sorted((plain.now(v, "sailed"), v) for v in range(31, 35) if plain.now(v, "sailed") is not None)
    assert [h["node"] for h in got["hits"]][: len(dated)] == [v for _, v in dated] and got["as_of"] == max(dated)[0] and len(got["context"].splitlines()) == 5
    p = e.query({"op": "pipeline", "source": {"nodes": list(VOYAGES)}, "steps": [{"expand": "piloted"}, {"filter_type": "Pilot"}]})
    assert sorted(p["ids"]) == sorted({plain.now(v, "piloted") for v in VOYAGES} - {None})


def test_strict_search_stops_at_the_index(harbour):
    e, _ = harbour
    e.query({"op": "index"})
    e.embed(text([{"node": 31, "vector": [8.1, 2.0, 0.0]}]))
    ask = {"op": "search", "type": "Voyage", "vector": [8.1, 2.0, 0.0], "k": 1}
    assert e.query(ask)["ids"] == [31] and e.query(ask | {"strict": True})["ids"] == [39]
    assert e.query({"op": "stats"})["index"]["rows"] == 16


def test_conformance_and_watch(harbour):
    e, plain = harbour
    judged = lambda r: {v["subject"]: (v["verdict"], v["kind"]) for v in r["verdicts"]}
    before = {v: plain.verdict(v) for v in VOYAGES}
    assert judged(e.query({"op": "conformance", "rule_name": "pilotage"})) == before
    assert {x for v in before.values() for x in v} >= {"OK", "MISMATCH", "NOT_APPLICABLE", "stale", "wrong"}
    seen = e.query({"op": "conformance_watch", "rule_name": "pilotage"})
    assert judged(seen) == before
    for seed in (1, 2):
        lines = lines_of(random.Random(seed), 25)
        e.ingest(text(lines))
        plain.take(lines)
    after = {v: plain.verdict(v) for v in VOYAGES}
    got = e.query({"op": "conformance_changes", "rule_name": "pilotage", "cursor": seen["cursor"]})
    name = lambda v: "/".join(x for x in v if x)
    last = {c["subject"]: c["new"] for c in got["changes"]}
    assert {v for v in VOYAGES if before[v] != after[v]} <= set(last) and all(last[v] == name(after[v]) for v in last)
    assert e.query({"op": "conformance_changes", "rule_name": "pilotage", "cursor": got["cursor"]})["changes"] == []
    assert judged(e.query({"op": "conformance", "rule_name": "pilotage"})) == after == judged(e.query({"op": "conformance_watch", "rule_name": "pilotage"}))


def test_writes(spark, tmp_path):
    where = f"file://{tmp_path}/s"
    e = Engine(Store(spark, where))
    e.ingest('{"pred_def": {"name": "a", "cardinality": "one"}}\n{"pred_def": {"name": "m"}}')
    x, y = fact(7, "a", {"int": 1}, source="s"), fact(7, "a", {"int": 2}, source="s")
    point = lambda g, p: g.query({"op": "point", "subject": 7, "predicate": p})
    assert e.ingest(text([x]))["facts"] == 1
    assert e.ingest(text([x])) == {"defs": 0, "nodes": 0, "facts": 0, "closes": 0, "retracts": 0, "suppressed": 1, "durable_head": e.store.head}
    assert e.ingest(text([x, y, x]))["facts"] == 2 and point(e, "a")["one"] == {"int": 1}
    e.ingest(text([{"close": {"subject": 7, "predicate": "a", "valid_from": 9}}, fact(7, "m", "k"), fact(7, "m", "l"), fact(7, "m", {"float": 0.25})]))
    assert point(e, "a") == {"one": None, "closed_from": 9}
    e.ingest(text([{"retract": {"subject": 7, "predicate": "m", "object": {"text": "k"}}}]))
    assert point(e, "m")["many"] == [{"float": 0.25}, {"text": "l"}]
    e.ingest(text([fact(7, "m", "k")]))
    before = [point(e, p) for p in "am"]
    e.query({"op": "compact"})
    again = Engine(Store(spark, where))
    assert [point(again, p) for p in "am"] == before and before[1]["many"] == [{"float": 0.25}, {"text": "k"}, {"text": "l"}]
    head = e.store.head
    for bad, why in [
        (fact(7, "zz", {"int": 1}), "unknown predicate"), ({"what": 1}, "not a known record"), ({"pred_def": {"name": "a", "cardinality": "many"}}, "cannot change"), ({"close": {"subject": 7, "predicate": "m"}}, "needs an object"),
        ({"retract": {"subject": 7, "predicate": "a", "object": {"int": 1}}}, "many-valued"), ({"node": {"id": 7, "label": 40}}, "label"),
    ]:
        with pytest.raises(ValueError, match=why):
            e.ingest(text([fact(5, "a", {"int": 1}), bad]))
    assert e.store.head == head and e.store.stats()["subjects"] == 1 and e.store.stats()["bytes"] > 0
    with pytest.raises(ValueError, match="not 2"):
        e.embed(text([{"node": 7, "vector": [1, 2]}, {"node": 7, "vector": [1]}]))
    with pytest.raises(ValueError, match="vector"):
        e.embed('{"node": 7}')
    assert e.embed(text([{"node": 7, "vector": [1, 2]}])) == 1
    e.query({"op": "reset"})
    assert e.store.stats()["rows"] == 0 and [n.name for n in (tmp_path / "s").iterdir() if not n.name.startswith((".", "manifest"))] == []
