"""The 17 comparisons against an evaluator of plain Python values, over a grid of rows, fields and values."""

import json
import re
from datetime import UTC, datetime, timedelta

import pytest
from flows import GET, event, rule, run, steps, store, value
from pyspark.sql import functions as F

from millrace.functions.dates import normalized
from millrace.functions.values import to_ms, to_number
from millrace.operators.rules import OPERATORS, compare, literal, rules
from millrace.plans.metrics import Period, compute_aggregate
from millrace.sources.records import EventStore, Field, field_of

ROWS = [
    ({"name": "Alice", "stage": "Won", "amount": "100", "when": "2026-03-01T10:00:00Z"}, "alice@acme.com", 100),
    ({"name": "ALICE", "stage": "WON", "amount": "100.50", "when": "2026-06-15"}, "ALICE@ACME.COM", 100.5),
    ({"name": "", "stage": "", "amount": "", "when": ""}, "", None),
    ({"other": "x"}, None, None),
    ({"name": None, "stage": None, "amount": None, "when": None}, None, None),
    ({"name": "Bob", "stage": "Lost", "amount": "not-a-number", "when": "not-a-date"}, "bob@x.io", 0),
    ({"name": "100% done", "stage": "a_b", "amount": "-5", "when": "2026-01-01"}, "x%y", -5),
    ({"name": "a_b", "stage": "A_B", "amount": "0", "when": "1999-12-31T23:59:59Z"}, "a_b", 0),
    ({"name": "  padded  ", "stage": " Won ", "amount": " 42 ", "when": " 2026-02-02 "}, " s ", 42),
    ({"name": "Ünïcödé", "stage": "ÉTÉ", "amount": "1e3", "when": "2026-12-25T00:00:00.500Z"}, "ü@x.io", 1000),
    ({"name": "42", "stage": "42", "amount": "42", "when": "2026-07-01"}, "42", 42),
    ({"name": "a,b", "stage": "a, b", "amount": "3.14", "when": "2026-05-05"}, "a,b", 3.14),
    ({"utm": {"source": "ig"}, "name": "nested", "stage": "New", "amount": "7", "when": "2026-04-04"}, "n@x.io", 7),
    ({"a.b": "flat-wins", "a": {"b": "walk"}, "name": "dotted", "stage": "New", "amount": "8", "when": "2026-04-05"}, "d@x.io", 8),
    ({"name": True, "stage": [1, "x"], "amount": 0.5, "when": {"x": 1}, "utm": {"source": 7}}, "t", 1e21),
    ({"name": "+5", "stage": "0x10", "amount": "+5", "a": {"b": [None]}}, "5", None),
]
FIELDS = ("name", "stage", "amount", "when", "properties.name", "missing", "utm.source", "a.b", "subject", "value", "eventType", "source")
VALUES = ("Won", "won", "WON", "", "alice", "ALICE", "100", "100.5", "0", "-5", "a_b", "100%", "%", "_", "2026-03-01T10:00:00Z", "2026-06-15", "not-a-date", "a,b", "Won,Lost", " Won , Lost ", "Ünïcödé", "42", "1e3")
START = datetime(2026, 3, 1, 10, tzinfo=UTC)


def rows():
    return [event("updated" if i % 2 else "row_added", s, v, p, at=START + timedelta(days=i), source="gsheets", id=str(i)) for i, (p, s, v) in enumerate(ROWS)]


def get(i, path):
    props, subject, number = ROWS[i]
    if path in ("subject", "value", "eventType", "source"):
        return {"subject": subject, "value": number, "eventType": "updated" if i % 2 else "row_added", "source": "gsheets"}[path]
    props, path = normalized(props), path.removeprefix("properties.")
    if path in props:
        return props[path]
    for part in path.split("."):
        props = props.get(part) if isinstance(props, dict) else None
    return props


def text(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, list):
        return ",".join(map(text, v))
    if isinstance(v, dict):
        return "[object Object]"
    if isinstance(v, float):
        return "1e+21" if v == 1e21 else repr(v).removesuffix(".0")
    return str(v)


def number(v):
    if isinstance(v, int | float) and not isinstance(v, bool):
        return float(v)
    s = v.strip() if isinstance(v, str) else ""
    if re.fullmatch(r"0x[0-9a-f]+", s):
        return float(int(s, 16))
    return float(s) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", s) else None


def moment(v):
    n = v if isinstance(v, int | float) and not isinstance(v, bool) else float(v) if isinstance(v, str) and re.fullmatch(r"-?\d+(\.\d+)?", v.strip()) else None
    if n is not None:
        return n if 1e18 > n >= 1e11 else n * 1000 if 1e11 > n >= 1e9 else None  # no moment lies beyond a long
    if not isinstance(v, str) or not re.match(r"\s*\d{4}-\d\d-\d\d", v):
        return None
    return datetime.fromisoformat(v.strip().replace("Z", "+00:00")).replace(tzinfo=UTC).timestamp() * 1000


def holds(op, v, w, second="2026-06-15"):
    a, x, y = text(v), number(v), number(w)
    t, u = moment(v), moment(w)
    return {
        "equals": a == w, "not_equals": a != w, "contains": w.lower() in a.lower(), "not_contains": w.lower() not in a.lower(), "starts_with": a.lower().startswith(w.lower()), "ends_with": a.lower().endswith(w.lower()),
        "gt": None not in (x, y) and x > y, "lt": None not in (x, y) and x < y, "gte": None not in (x, y) and x >= y, "lte": None not in (x, y) and x <= y,
        "is_empty": a == "", "is_not_empty": a != "", "is_one_of": a in [z.strip() for z in w.split(",")], "is_not_one_of": a not in [z.strip() for z in w.split(",")],
        "before": t is not None and (u is None or t < u), "after": t is not None and (u is None or t > u), "between": None not in (t, u) and u <= t <= moment(second) + 86_399_999,
    }[op]


@pytest.mark.parametrize("path", FIELDS)
def test_grid(spark, path):
    frame = store(spark, rows()).scan()
    values = spark.createDataFrame([(v,) for v in VALUES], "_w string")
    f = field_of(frame, path)
    read = frame.df.select("id", f.text.alias("t"), f.number.alias("n"), f.ms.alias("m")).persist()
    f = Field(F.col("t"), F.col("n"), F.col("m"), F.lit(True))
    got = read.crossJoin(values).select("id", "_w", *[compare(op, f, literal_of(F.col("_w")), "2026-06-15").alias(op) for op in OPERATORS]).collect()
    wrong = [(r["id"], op, r["_w"], r[op]) for r in got for op in OPERATORS if r[op] is not holds(op, get(int(r["id"]), path), r["_w"])]
    assert wrong == []


def literal_of(c):
    return Field(c, to_number(c), to_ms(c), F.lit(True))


def passing(spark, *found, combinator="and"):
    return {int(r["id"]) for r in run(spark, rows(), steps(GET, ("f", "filter", {"combinator": combinator, "rules": list(found)}))).df("f").select("id").collect()}


def test_pinned_points(spark):
    assert 0 not in passing(spark, rule("stage", "equals", "won")) and 0 in passing(spark, rule("stage", "contains", "won"))
    assert passing(spark, rule("name", "contains", "%")) == {6}
    assert len(passing(spark, rule("missing", "not_equals", "x"))) == len(ROWS)
    assert passing(spark, rule("amount", "gt", "not-a-number")) == set() == passing(spark, rule("name", "no such", "x"))
    assert passing(spark, rule("missing", "equals", "")) == set(range(len(ROWS)))


def test_literals_agree_with_columns(spark):
    """Conditions on physical columns take plainer forms than on fields."""
    frame = store(spark, rows()).scan()
    for path in ("subject", "value", "eventType"):
        for op in OPERATORS:
            got = {r["id"]: r["c"] for r in frame.df.select("id", rules(frame, {"rules": [rule(path, op, "42", value2="2026-06-15")]}).alias("c")).collect()}
            assert got == {str(i): holds(op, get(i, path), "42") for i in range(len(ROWS))}, (path, op)
    assert compare("equals", literal("1"), literal("1")) is not None


def test_fields_against_fields(spark):
    found = run(spark, rows(), steps(GET, ("f", "filter", {"rules": [rule("name", "equals", valueKind="field", valueField="stage")]}))).df("f")
    assert {r["id"] for r in found.collect()} == {"10"}  # two blanks are not equal here
    with pytest.raises(Exception, match="No record has both"):
        run(spark, rows(), steps(GET, ("f", "filter", {"rules": [rule("stage", "equals", valueKind="field", valueField="missing")]}))).df("f").collect()


def test_combinators_and_date_range(spark):
    a, b = rule("stage", "equals", "Won"), rule("name", "equals", "Bob")
    assert passing(spark, a, b) == set() and passing(spark, a, b, combinator="or") == {0, 5}
    ranged = {"dateRange": {"enabled": True, "mode": "between", "from": "2026-03-02", "to": "2026-03-04", "dateField": "occurredAt"}}
    assert {r["id"] for r in run(spark, rows(), steps(GET, ("f", "filter", ranged))).df("f").collect()} == {"1", "2", "3"}


def test_array_paths_and_quotes(spark):
    data = [event(props={"emails": [{"email": "a@b.c"}], 'x "y"': "q", "it's": "r", "Both \"'": "s", "How many? (x)": "5"})]
    frame = store(spark, data).scan()
    got = frame.df.select(*[field_of(frame, p).text for p in ("emails.0.email", 'x "y"', "it's", "Both \"'", "How many? (x)")]).first()
    assert tuple(got) == ("a@b.c", "q", "r", "s", "5")
    assert json.loads(data[0]["properties"])


def test_filters_reach_the_scan(spark, tmp_path):
    store(spark, rows()).df.write.parquet(str(tmp_path / "e"))
    found = EventStore(spark.read.parquet(str(tmp_path / "e"))).scan(event_type="updated")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = found.where(rules(found, {"rules": [rule("subject", "equals", "42"), rule("value", "gt", "3")]})).df.select("id")._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan)[1]
    assert all(x in pushed for x in ("EqualTo(subject,42)", "GreaterThan(value,3.0)", "EqualTo(eventType,updated)"))
    assert "properties" not in re.search(r"ReadSchema: (.*)", plan)[1]


def test_classic_rules_are_three_valued(spark):
    s, period = store(spark, rows()), Period(0, 4_000_000_000_000)
    count = lambda *r: compute_aggregate(s, {"filters": {"rules": list(r)}}, period).first()[0]
    assert count(rule("properties.name", "equals", "Bob")) == 1
    assert count(rule("properties.name", "not_equals", "Bob")) == len(ROWS) - 3  # rows without a name drop out
    assert count(rule("properties.name", "contains", "a_b")) == 1 + sum("a" in str(p.get("name")) and re.search("a.b", str(p.get("name"))) is not None for p, _, _ in ROWS if p.get("name") != "a_b")
    assert count(rule("eventType", "in", "updated, ")) == 8 and count(rule("eventType", "in", " , ")) == 0
    assert value(run(spark, [], steps(GET, ("n", "formula", {"op": "count"}))), "n") == 0
