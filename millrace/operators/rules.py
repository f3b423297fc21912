"""Filter conditions: the 17 comparisons of flow steps and the 8 of classic metrics.

Conditions are Columns that are never null, except the classic ones, which follow
SQL's three-valued logic. A comparison with a literal on a physical column stays a
plain predicate, so it reaches the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.dates import parse_date
from millrace.functions.values import DAY_MS, to_ms, to_number
from millrace.sources.records import STANDARD, Field, Frame, bare, field_of

OPERATORS = ("equals", "not_equals", "contains", "not_contains", "starts_with", "ends_with", "gt", "lt", "gte", "lte", "is_empty", "is_not_empty", "is_one_of", "is_not_one_of", "before", "after", "between")
_EMPTY = ("is_empty", "is_not_empty")
#: Comparisons of whole texts: a typed-in text that is no date equals no date.
_EQUALITIES = ("equals", "not_equals", "is_one_of", "is_not_one_of")
_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def listed(text: str) -> list[str]:
    return [x.strip() for x in text.split(",")]


def literal(value: str) -> Field:
    """The readings of a typed-in value."""
    v = F.lit(value)
    return Field(v, lambda: to_number(v), lambda: to_ms(v), F.lit(True))


def day_end(ms: Column, text: Column) -> Column:
    """A bare date means the whole of its day."""
    return ms + F.when(F.trim(text).rlike(_DAY), DAY_MS - 1).otherwise(0)


def compare(op: str, f: Field, g: Field, second: str = "") -> Column:
    """One comparison of two fields' readings."""
    a, b = F.coalesce(f.text, F.lit("")), F.coalesce(g.text, F.lit(""))
    sure = lambda c: F.coalesce(c, F.lit(False))
    if op in ("gt", "lt", "gte", "lte"):
        x, y = f.number, g.number
        return sure({"gt": x > y, "lt": x < y, "gte": x >= y, "lte": x <= y}[op])
    if op in ("equals", "not_equals"):
        return a == b if op == "equals" else a != b
    if op in ("contains", "not_contains"):
        hit = F.contains(F.lower(a), F.lower(b))
        return hit if op == "contains" else ~hit
    if op == "starts_with":
        return F.startswith(F.lower(a), F.lower(b))
    if op == "ends_with":
        return F.endswith(F.lower(a), F.lower(b))
    if op in _EMPTY:
        return a == "" if op == "is_empty" else a != ""
    if op in ("is_one_of", "is_not_one_of"):
        hit = F.array_contains(F.transform(F.split(b, ","), lambda x: F.trim(x)), a)
        return hit if op == "is_one_of" else ~hit
    if op in ("before", "after"):
        # A bound that is no date does not bind.
        bound = F.coalesce(g.ms.cast("double"), F.lit(float("inf") if op == "before" else float("-inf")))
        at = f.ms.cast("double")
        return sure(at < bound if op == "before" else at > bound)
    if op == "between":
        end = F.lit(second)
        return sure((f.ms >= g.ms) & (f.ms <= day_end(to_ms(end), end)))
    return F.lit(False)


def _plain(frame: Frame, path: str) -> tuple[Column, T.DataType] | None:
    """The column behind a path, if there is one."""
    name = path if path in STANDARD else frame.physical.get(bare(path))
    return (F.col(name), frame.df.schema[name].dataType) if name else None


def rule(frame: Frame, r: dict) -> Column:
    """A condition {field, op, value, value2, valueKind, valueField} as a Column."""
    op, value = r["op"], str(r.get("value") or "")
    if r.get("valueKind") == "field":
        f, g = field_of(frame, r["field"]), field_of(frame, r.get("valueField") or "")
        hit = compare(op, f, g, str(r.get("value2") or ""))
        if op in (*_EMPTY, "gt", "lt", "gte", "lte"):
            return hit  # blanks are no numbers, so two of them never compare
        return hit & ((F.coalesce(f.text, F.lit("")) != "") | (F.coalesce(g.text, F.lit("")) != ""))
    column = _plain(frame, r["field"])
    if column and isinstance(column[1], T.StringType):
        c = column[0]
        if op == "equals" and value:
            return c.isNotNull() & (c == value)
        if op == "is_one_of" and "" not in listed(value):
            return c.isNotNull() & c.isin(listed(value))
        if op == "is_not_empty":
            return c.isNotNull() & (c != "")
        if op == "starts_with" and value and value.lower() == value.upper():
            return c.isNotNull() & c.startswith(value)
    if column and isinstance(column[1], T.NumericType) and op in ("gt", "lt", "gte", "lte"):
        try:
            n = float(value)
        except ValueError:
            n = float("nan")
        if n == n and abs(n) != float("inf"):
            c = column[0]
            return c.isNotNull() & {"gt": c > n, "lt": c < n, "gte": c >= n, "lte": c <= n}[op]
    found = field_of(frame, r["field"])
    if op in _EQUALITIES and not any(parse_date(x, bare(r["field"]).rpartition(".")[2]) for x in [value, *listed(value)]):
        found = found.undated()
    return compare(op, found, literal(value), str(r.get("value2") or ""))


def rules(frame: Frame, config: dict) -> Column:
    """A set of conditions, joined by its combinator; none passes everything."""
    found = [rule(frame, r) for r in config.get("rules") or []]
    if not found:
        return F.lit(True)
    return reduce(lambda a, b: a | b if config.get("combinator") == "or" else a & b, found)


def never_comparable(frame: Frame, config: dict) -> list[tuple[Column, str]]:
    """For every field-against-field condition: whether a record has both fields, and the
    error if no record of a step that has any does."""
    out = []
    for r in config.get("rules") or []:
        if r.get("valueKind") == "field" and r.get("valueField"):
            both = field_of(frame, r["field"]).filled & field_of(frame, r["valueField"]).filled
            out.append((both, f'No record has both "{bare(r["field"])}" and "{bare(r["valueField"])}", so the condition that compares them cannot hold.'))
    return out


# ---- classic metrics -----------------------------------------------------------


def classic_field(path: str) -> Column:
    """subject, source, eventType and value by name, else a top-level property as text."""
    if path in ("subject", "source", "eventType", "value"):
        return F.col(path)
    key = bare(path)
    quoted = f'$["{key}"]' if '"' not in key else f"$['{key}']"
    v = F.try_variant_get("properties", quoted, "variant")
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.when(~F.is_variant_null(v), F.to_json(v)))


def classic_rule(r: dict) -> Column:
    """Null in, null out: rows without the field drop from both equals and not_equals. A
    text that is no number fails numeric comparisons loudly."""
    c, op, v = classic_field(r["field"]), r["op"], str(r.get("value", ""))
    if op in ("equals", "not_equals"):
        wanted = F.lit(float(v)) if r["field"] == "value" else F.lit(v)
        return c == wanted if op == "equals" else c != wanted
    if op == "contains":
        return c.cast("string").ilike(f"%{v}%")
    if op == "in":
        names = [x for x in listed(v) if x]
        return c.cast("string").isin(names) if names else F.lit(False)
    n, x = float(v), c.cast("double")
    return {"gt": x > n, "lt": x < n, "gte": x >= n, "lte": x <= n}[op]


def classic_rules(config: dict | None) -> Column | None:
    found: Sequence[Column] = [classic_rule(r) for r in (config or {}).get("rules") or []]
    if not found:
        return None
    return reduce(lambda a, b: a | b if (config or {}).get("combinator") == "or" else a & b, found)
