from datetime import UTC, datetime, timedelta

import pytest
from flows import GET, NOW, event, rule, run, steps, value

from millrace.operators.windows import RANGES, dashboard_range, ms, window
from millrace.plans.engine import Err
from millrace.plans.tiles import build_tile, delta, delta_text, duration_unit, format_value, next_change_of, sample, tile_by_range
from millrace.sources.records import field_of

COUNT = ("n", "formula", {"op": "count"})


def total(spark, rows, op, **config):
    return value(run(spark, rows, steps(GET, ("n", "formula", {"op": op, **config}))), "n")


def test_counts_and_aggregates(spark):
    deals = [event("deal", "a", 100), event("deal", "a", 300), event("deal", "b", 200)]
    assert [total(spark, deals, op) for op in ("count", "sum", "avg", "count_distinct", "median", "min", "max")] == [3, 600, 200, 2, 200, 100, 300]
    assert [total(spark, [], op) for op in ("count", "sum", "avg", "count_distinct", "median", "min", "max")] == [0] * 7
    assert "No record has a number" in total(spark, deals, "sum", field="properties.none")
    assert "to count" in total(spark, deals, "count_distinct", distinctField="properties.none")


def test_series_and_groups(spark):
    rows = [event(days=1), event(days=1), event("canceled", days=3, value=5)]
    r = run(spark, rows, steps(GET, ("s", "formula", {"op": "count", "groupBy": {"type": "time", "unit": "day"}})))
    assert sorted(map(tuple, r.df("s").collect())) == [("2026-08-15", 1.0), ("2026-08-17", 2.0)]
    tile = build_tile(r, "s").first()
    assert tile["value"] == 3 and [tuple(x) for x in tile["series"]] == [("2026-08-15", 1.0), ("2026-08-17", 2.0)]
    g = run(spark, rows, steps(GET, ("g", "formula", {"op": "sum", "groupBy": {"type": "field", "field": "properties.x"}})))
    assert [tuple(x) for x in build_tile(g, "g").first()["groups"]] == [("(not set)", 5.0)]


def test_multi_column(spark):
    name, phone = "How many? (CRM)", "PHONE"
    cells = [("1", "12"), ("3", "3"), ("6", "0 (the same 4 leads)"), ("0", "2"), ("3", "0")]
    rows = [event("row", props={name: a, phone: b}) for a, b in cells]
    both = {"field": f"properties.{name}", "extraFields": [phone, phone, " "]}
    assert [total(spark, rows, op, **both) for op in ("sum", "avg", "max", "min", "median", "count")] == [30, 6, 13, 2, 6, 5]
    assert total(spark, rows, "sum", field=name) == 13 and total(spark, rows, "sum", field=phone) == 17
    assert 'the field "gone"' in total(spark, rows, "sum", field=name, extraFields=["gone"])
    blank = [event("row", props={name: "1", "b": ""})]
    assert total(spark, blank, "sum", field=name, extraFields=["b"]) == 1


def test_categories(spark):
    cats = [{"label": x, "filters": {"rules": [rule("eventType", "equals", x.lower())]}} for x in ("Booked", "Canceled", "Never")]
    r = run(spark, [event("booked"), event("canceled"), event("weird")], steps(GET, ("g", "group", {"mode": "categories", "categories": cats})))
    assert {x["label"]: (x["value"], x["place"]) for x in r.df("g").collect()} == {"Booked": (1, 0), "Canceled": (1, -1), "Never": (0, -2), "Other": (1, -3)}


@pytest.mark.parametrize(("op", "wanted"), [("add", 6), ("average", 3), ("subtract", 2), ("difference", 2), ("multiply", 8), ("divide", 2), ("ratio", 2), ("percentage", 200), ("percent_change", 100)])
def test_formulas(spark, op, wanted):
    assert value(run(spark, [], steps(("x", "formula", {"op": op, "aFixed": 4, "bFixed": 2}), edges=[])), "x") == wanted


def test_formula_errors_and_operands(spark):
    rows = [event("deal", value=8, props={"cell": "4"}), event("other")]
    deal = ("deal", "filter", {"rules": [rule("eventType", "equals", "deal")]})
    none = ("none", "filter", {"rules": [rule("eventType", "equals", "none")]})
    edges = [("get", "deal"), ("get", "none"), ("get", "x", "a")]
    made = lambda config, last: value(run(spark, rows, steps(GET, deal, none, ("x", "formula", config), edges=[*edges, last])), "x")
    assert made({"op": "divide", "bField": "properties.cell"}, ("deal", "x", "b")) == 0.5
    assert "zero" in made({"op": "divide"}, ("none", "x", "b"))
    assert "no record" in made({"op": "divide", "bField": "cell"}, ("none", "x", "b"))
    assert "holds 2 records" in made({"op": "divide", "bField": "cell"}, ("get", "x", "b"))
    assert "is no number" in made({"op": "divide", "bField": "eventType"}, ("deal", "x", "b"))
    bad = run(spark, rows, steps(GET, ("g", "group", {}), ("x", "formula", {"op": "add", "bFixed": 1}), ("below", "output", {}), edges=[("get", "g"), ("g", "x", "a"), ("x", "below")]))
    assert isinstance(bad.results["x"], Err) and isinstance(bad.results["below"], Err)


def test_stacked_calculations_reach_back(spark):
    rows = [event(value=1), event(value=5)]
    r = run(spark, rows, steps(GET, ("a", "formula", {"op": "sum"}), ("b", "formula", {"op": "max"}), ("g", "group", {"field": "eventType"})))
    assert value(r, "b") == 5 and r.df("g").first()["value"] == 2


def dedupe(spark, rows, keep, order="occurredAt"):
    r = run(spark, rows, steps(("get", "app", {"dedupe": True, "dedupeKeep": keep, "dedupeOrderField": order})))
    return r


def test_keep_one(spark):
    rows = [event(subject="+1914", value=v, days=d) for v, d in ((1, 5), (2, 2), (3, 1))]
    assert [dedupe(spark, rows, k).df("get").first()["value"] for k in ("earliest", "latest")] == [1, 3]
    calls = [event(subject="s", props={"dur": 30}, days=1, value=30), event(subject="s", props={"dur": 900}, days=5, value=900)]
    assert [dedupe(spark, calls, k, "properties.dur").df("get").first()["value"] for k in ("latest", "earliest")] == [900, 30]
    some = [event(subject="s", props={"dur": 60}, days=3, value=1), event(subject="s", days=1, value=2)]
    assert [dedupe(spark, some, k, "properties.dur").df("get").first()["value"] for k in ("latest", "earliest")] == [1, 1]
    mixed = [event(subject="b", days=1), event(subject="a", days=2), event(subject="a", days=9), event(subject=None), event(subject=" ")]
    r = dedupe(spark, mixed, "earliest")
    assert [x["subject"] for x in r.df("get").orderBy("_ord", ascending=False).collect()] == [" ", None, "b", "a"]
    assert r.ok("get").report.first().asDict() == {"loaded": 5, "matched": 3, "groups": 2, "ordered": 2, "removed": 1}


@pytest.mark.parametrize("keep", ["latest", "earliest"])
def test_keep_one_ties(spark, keep):
    """500 records, 40 groups, 25 moments: the first seen, newest first, wins ties."""
    seed, rows = 7, []

    def draw(n):
        nonlocal seed
        seed = (seed * 1103515245 + 12345) % 2**31
        return seed % n

    for i in range(500):
        rows.append(event(subject=f"g{draw(40)}", days=draw(25), id=f"{i:04d}"))
    seen = {}
    for r in sorted(rows, key=lambda r: (r["occurredAt"], r["id"]), reverse=True):
        old = seen.get(r["subject"])
        if old is None or (r["occurredAt"] > old["occurredAt"] if keep == "latest" else r["occurredAt"] < old["occurredAt"]):
            seen[r["subject"]] = r
    got = dedupe(spark, rows, keep).df("get").select("subject", "id").collect()
    assert {r["subject"]: r["id"] for r in got} == {k: r["id"] for k, r in seen.items()}


def matched(spark, kept, listed, mode="appears", key="properties.k", lookup="properties.v"):
    rows = [event("contact", props={key.split(".")[1]: k}) for k in kept] + [event("row", props={lookup.split(".")[1]: v}) for v in listed]
    nodes = [("a", "app", {"eventType": "contact"}), ("b", "app", {"eventType": "row"}), ("m", "unite", {"mode": "match", "keepNodeId": "a", "keyField": key, "lookupField": lookup, "matchMode": mode})]
    return run(spark, rows, steps(*nodes, edges=[("a", "m"), ("b", "m")]))


def names(r, path):
    f = r.frame("m")
    return sorted(x[0] or "" for x in f.df.select(field_of(f, path).text).collect())


def test_match(spark):
    r = matched(spark, ["anna", " BOB ", "carol", None], ["Anna", "bob", "nobody", "bob"])
    assert names(r, "k") == [" BOB ", "anna"]
    assert r.ok("m").report.first().asDict() == {"checked": 4, "kept": 2, "dropped": 2, "blanks": 1, "phones": 0, "listSize": 3, "listBlanks": 0}
    assert names(matched(spark, ["anna", "dave", None], ["anna"], "missing"), "k") == ["", "dave"]
    assert names(matched(spark, ["+1 208-613-0936"], ["2086130936"], "appears", "properties.phone", "properties.Phone_number"), "phone") == ["+1 208-613-0936"]
    assert names(matched(spark, ["20250804093000"], ["20260804093000"]), "k") == []
    assert names(matched(spark, ["55548"], ["155548"], "appears", "properties.phone", "properties.cell"), "phone") == []
    assert names(matched(spark, ["a"], [], "missing"), "k") == ["a"]
    with pytest.raises(Exception, match="No record of the list"):
        matched(spark, ["a"], [None, " "]).df("m").collect()


T0 = datetime(2026, 7, 1, 12, tzinfo=UTC)
PAIR = {"keyField": "properties.lead", "startField": "occurredAt", "startStep": "lead", "endField": "occurredAt", "endStep": "call"}
LEADS = [("lead", "app", {"eventType": "lead"}), ("call", "app", {"eventType": "call"}), ("both", "unite", {}), ("pair", "time_between", PAIR)]
WIRED = [("lead", "both"), ("call", "both"), ("both", "pair")]


def pairs(spark, *seen):
    rows = [event(kind, at=T0 + timedelta(minutes=m), props={"lead": key} if key else {}) for kind, key, m in seen]
    r = run(spark, rows, steps(*LEADS, edges=WIRED))
    f = r.frame("pair")
    return {x[0]: x[1] for x in f.df.select("subject", field_of(f, "properties.time_between.minutes").number).collect()}, r


def test_time_between(spark):
    assert pairs(spark, ("lead", "1", 0), ("call", "1", 10), ("call", "1", 45), ("lead", "2", 5), ("call", "2", 35))[0] == {"1": 10, "2": 30}
    assert pairs(spark, ("call", "1", 0), ("lead", "1", 5), ("call", "1", 45))[0] == {"1": 40}
    assert pairs(spark, ("call", "1", -30), ("lead", "1", 0), ("call", "1", 20))[0] == {"1": 20}
    assert pairs(spark, ("lead", "1", 15), ("lead", "1", 0), ("call", "1", 25), ("call", None, 1))[0] == {"1": 25}
    got, r = pairs(spark, ("lead", "1", 0), ("call", "1", 10), ("lead", "never", 0), ("lead", "before", 20), ("call", "before", 5))
    assert got == {"1": 10} and r.ok("pair").report.first().asDict() == {"keys": 3, "started": 3, "matched": 1, "noStop": 1, "stopBeforeStart": 1}
    _, r = pairs(spark, ("lead", "1", 0), ("call", "1", 120))
    f = r.frame("pair")
    assert tuple(f.df.select(*[field_of(f, f"time_between.{u}").number for u in ("seconds", "minutes", "hours", "days")]).first()) == (7200, 120, 2, 1 / 12)


def test_time_between_needs_to_know_its_steps(spark):
    nodes = [*LEADS[:3], ("pair", "time_between", {**PAIR, "startStep": "", "endStep": ""})]
    rows = [event("lead", props={"lead": 1}), event("call", props={"lead": 1})]
    with pytest.raises(Exception, match="several steps"):
        run(spark, rows, steps(*nodes, edges=WIRED)).df("pair").collect()


def test_same_record_is_not_its_own_stop(spark):
    rows = [event("lead", at=T0 + timedelta(minutes=m), props={"lead": "1"}) for m in (0, 7)]
    config = {"keyField": "lead", "startField": "occurredAt", "endField": "occurredAt"}
    r = run(spark, rows, steps(GET, ("pair", "time_between", config)))
    f = r.frame("pair")
    assert f.df.select(field_of(f, "time_between.minutes").number).first()[0] == 7


def test_step_stamps(spark):
    rows = [event("a"), event("b"), event("b")]
    keep = ("f", "filter", {"rules": [rule("eventType", "equals", "b")]})
    r = run(spark, rows, steps(GET, keep, ("s", "unite", {}), ("in", "filter", {"rules": [rule("__count_f", "equals", "2")]}), edges=[("get", "s"), ("get", "f"), ("f", "s"), ("s", "in")]))
    assert r.df("s").count() == 5 and r.df("in").count() == 2


def test_paths(spark):
    branches = {"paths": [{"id": "b", "label": "B"}, {"id": "all", "label": "A", "mode": "always"}, {"id": "rest", "label": "R", "mode": "fallback"}], "fallbackId": "old"}
    nodes = [GET, ("p", "paths", branches), ("f", "filter", {"rules": [rule("eventType", "equals", "b")]}), ("x", "filter", {}), ("y", "filter", {}), ("z", "filter", {})]
    r = run(spark, [event("a"), event("b"), event("b")], steps(*nodes, edges=[("get", "p"), ("p", "f", None, "b"), ("p", "x", None, "all"), ("p", "y", None, "rest"), ("p", "z", None, "old")]))
    assert [r.df(n).count() for n in "fxyz"] == [2, 3, 1, 1]


def test_windows():
    at = lambda *a: ms(datetime(*a, tzinfo=UTC))
    got = {p: window({"preset": p}, NOW) for p in ("today", "yesterday", "this_week", "last_week", "this_month", "last_month", "last_7_days", "odd")}
    now = ms(NOW)
    assert got == {
        "today": (at(2026, 8, 18), now), "yesterday": (at(2026, 8, 17), at(2026, 8, 18) - 1), "this_week": (at(2026, 8, 17), now), "last_week": (at(2026, 8, 10), at(2026, 8, 17) - 1),
        "this_month": (at(2026, 8, 1), now), "last_month": (at(2026, 7, 1), at(2026, 8, 1) - 1), "last_7_days": (now - 7 * 86_400_000, now), "odd": (0, now),
    }
    assert window({"mode": "between", "from": "2026-08-01", "to": "2026-08-31"}, NOW) == (at(2026, 8, 1), at(2026, 9, 1) - 1)
    assert window({"mode": "between", "from": "", "to": ""}, NOW) == (0, float("inf"))
    assert window({"mode": "rolling", "days": 2}, NOW) == (now - 2 * 86_400_000, now)


def ranges(*keys):
    return [dashboard_range(k, NOW) for k in keys or RANGES]


def by_range(r, node, field=None):
    return {x["_range"]: x for x in tile_by_range(r, node, ranges(), field).collect()}


def test_ranges_keep_pairs_together(spark):
    rows = [event("lead", at=datetime(2026, 8, 17, 18, tzinfo=UTC), props={"lead": "1"}), event("call", at=datetime(2026, 8, 18, 9, tzinfo=UTC), props={"lead": "1"})]
    nodes = [*LEADS, ("avg", "formula", {"op": "avg", "field": "properties.time_between.hours"})]
    got = by_range(run(spark, rows, steps(*nodes, edges=[*WIRED, ("pair", "avg")])), "avg")
    assert (got["yesterday"]["value"], got["all"]["value"], got["today"]["value"]) == (15, 15, 0)


def test_ranges_after_dedupe_and_empty_denominators(spark):
    rows = [event(subject="k", days=5), event(subject="k", minutes=-60)]
    got = by_range(run(spark, rows, steps(("get", "app", {"dedupe": True, "dedupeKeep": "earliest"}), COUNT)), "n")
    assert (got["all"]["value"], got["today"]["value"]) == (1, 0)
    nodes = [("a", "app", {"eventType": "a"}), ("b", "app", {"eventType": "b"}), ("x", "formula", {"op": "percentage"})]
    got = by_range(run(spark, [event("a", minutes=-5), event("b", days=3)], steps(*nodes, edges=[("a", "x", "a"), ("b", "x", "b")])), "x")
    assert got["all"]["value"] == 100 and got["today"]["value"] is None and "zero" in got["today"]["error"]


def test_ranges_by_another_date(spark):
    rows = [event(props={"starts_at": "2026-08-18T10:00:00Z"}, days=40), event(props={"starts_at": None})]
    got = by_range(run(spark, rows, steps(GET, COUNT)), "n", "properties.starts_at")
    assert (got["all"]["value"], got["today"]["value"], got["today"]["undated"], got["all"]["undated"]) == (2, 1, 1, 0)


def test_next_change(spark):
    rows = [event(minutes=30), event(at=NOW - timedelta(days=7) + timedelta(minutes=5))]
    r = run(spark, rows, steps(GET, COUNT))
    assert next_change_of(r, "n", ranges(), ms(NOW)).first()[0] == ms(NOW) + 5 * 60_000
    assert next_change_of(run(spark, [], steps(GET, COUNT)), "n", ranges(), ms(NOW)).first()[0] == ms(datetime(2026, 8, 19, tzinfo=UTC))


def test_preview_delta_and_format(spark):
    rows = [event(days=d, id=str(d)) for d in (1, 7, -30, -300)]
    assert [x["id"] for x in sample(run(spark, rows, steps(GET)), "get", ms(NOW)).collect()] == ["1", "7", "-30"]
    series = spark.createDataFrame([("1", 1.0), ("2", 4.0), ("3", 9.0)], "bucket string, value double")
    assert tuple(delta(series).first()) == (4, 1) and delta(series.limit(2)).first()[0] is None
    assert (delta_text(150, 100), delta_text(3, 0), delta_text(5, 2, True)) == ("+50%", "+3", "+3.0 pts")
    assert (format_value(1234.5, precision=1), format_value(-3, "currency"), format_value(12.3, "percent", 1), format_value(None)) == ("1,234.5", "-$3", "12.3%", "–")
    assert (format_value(90, "duration"), format_value(0, "duration"), format_value(90, "duration", 1, display="hours")) == ("1h 30m", "0s", "1.5 hours")
    assert (duration_unit("properties.time_between.hours"), duration_unit("call_min"), duration_unit("amount")) == ("hours", "minutes", None)
