"""Operators between records: one of each group, matching against a list, stacking,
splitting into paths, and pairing starts with stops.

Nothing gathers a group in one task: survivors and pairs come from aggregations that
combine on the map side, so a key with a third of all rows costs no more than another.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.values import iso_ms, let, trimmed
from millrace.operators.rules import rules
from millrace.sources.records import Frame, bare, field_of

_PHONE_NAME = re.compile(r"phone|mobile|msisdn|whatsapp").search


def _packed(df: DataFrame, but: Sequence[str] = ()) -> Column:
    return F.struct(*[c for c in df.columns if c not in but])


# ---- one of each group ---------------------------------------------------------


def keep_one(frame: Frame, group_field: str = "subject", keep: str = "latest", order_field: str = "occurredAt") -> Frame:
    """The latest or earliest record of each group, in the place of the group's first one.

    Records without a group all stay. Ties, and groups in which nothing can be ordered,
    keep the record that comes first; what can be ordered beats what cannot."""
    key, at = trimmed(F.coalesce(field_of(frame, group_field).text, F.lit(""))), field_of(frame, order_field).order
    keyed = frame.df.withColumns({"_key": key, "_at": at})
    rank = F.struct(F.col("_at").isNotNull().alias("has"), (F.col("_at") if keep == "latest" else -F.col("_at")).alias("at"), "_ord")
    best = keyed.where("_key != ''").groupBy("_key").agg(F.max_by(_packed(keyed, ("_key", "_at")), rank).alias("r"), F.max("_ord").alias("first"))
    kept = best.select(*[F.col("first").alias("_ord") if c == "_ord" else F.col("r")[c].alias(c) for c in frame.df.columns])
    return replace(frame, df=kept.unionByName(keyed.where("_key = ''").drop("_key", "_at")))


def keep_one_report(frame: Frame, group_field: str = "subject", order_field: str = "occurredAt") -> DataFrame:
    """loaded, matched, groups, ordered, removed: one row."""
    key, at = trimmed(F.coalesce(field_of(frame, group_field).text, F.lit(""))), field_of(frame, order_field).order
    groups = frame.df.select(key.alias("k"), at.isNotNull().alias("has")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("has").alias("has"))
    named = F.col("k") != ""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    found = groups.agg(total(F.col("n")).alias("loaded"), total(F.when(named, F.col("n"))).alias("matched"), F.count_if(named).alias("groups"), F.count_if(named & F.col("has")).alias("ordered"))
    return found.withColumn("removed", F.col("matched") - F.col("groups"))


# ---- match ---------------------------------------------------------------------


def phone_named(path: str) -> bool:
    parts = re.split(r"[._]", path.lower())
    return any(_PHONE_NAME(p) or p in ("tel", "cell") for p in parts)


def match_key(text: Column, phones: bool) -> Column:
    """Trimmed, lower case, null if blank; phone numbers are their last ten digits."""
    plain = F.lower(trimmed(text))
    if not phones:
        return F.nullif(plain, F.lit(""))

    def number(s: Column) -> Column:
        digits = F.regexp_replace(s, "[^0-9]", "")
        return F.when(s.rlike(r"^[+()\-.\s\d]+$") & F.length(digits).between(10, 15), F.concat(F.lit("tel:"), F.right(digits, F.lit(10)))).when(s != "", s)

    return let(plain, number)


def _keys(kept: Frame, listed: Frame, key_field: str, lookup_field: str) -> tuple[Column, Column]:
    phones = phone_named(bare(key_field)) and phone_named(bare(lookup_field))
    return match_key(field_of(kept, key_field).text, phones), match_key(field_of(listed, lookup_field).text, phones)


def match(kept: Frame, listed: Frame, key_field: str, lookup_field: str, mode: str = "appears") -> Frame:
    """The records of one step whose key is (appears) or is not (missing) in another
    step's list. Rows are never multiplied; blank keys are never in the list."""
    key, lookup = _keys(kept, listed, key_field, lookup_field)
    wanted = listed.df.select(lookup.alias("_key")).where("_key is not null").distinct()
    rows = kept.df.withColumn("_key", key)
    return replace(kept, df=rows.join(wanted, "_key", "left_semi" if mode == "appears" else "left_anti").drop("_key"))


def blank_list(listed: Frame, lookup_field: str) -> DataFrame:
    """One row: the list has records and none has a key, which is an error."""
    key = match_key(field_of(listed, lookup_field).text, False)
    return listed.df.agg(((F.count(F.lit(1)) > 0) & (F.count(key) == 0)).alias("blank"))


def match_report(kept: Frame, listed: Frame, key_field: str, lookup_field: str, mode: str = "appears") -> DataFrame:
    """checked, kept, dropped, blanks, listSize, listBlanks, phones: one row."""
    key, lookup = _keys(kept, listed, key_field, lookup_field)
    wanted = listed.df.select(lookup.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    sizes = wanted.agg(F.count("k").alias("listSize"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("listBlanks"))
    rows = kept.df.select(key.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).join(wanted.select("k", F.lit(True).alias("hit")).where("k is not null"), "k", "left")
    hit = F.coalesce("hit", F.lit(False))
    stays = hit if mode == "appears" else ~hit
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    counts = rows.agg(total(F.lit(True)).alias("checked"), total(stays).alias("kept"), total(~stays).alias("dropped"), total(F.col("k").isNull()).alias("blanks"), total(F.col("k").startswith("tel:")).alias("phones"))
    return counts.crossJoin(F.broadcast(sizes))  # a row by a row


# ---- stack and split -----------------------------------------------------------


def stack(frames: Sequence[Frame]) -> Frame:
    """All records of several steps, one after another; repeated records stay."""
    out, physical, counts = None, {}, {}
    for i, f in enumerate(frames):
        lane = F.concat(F.lit(f"{9999 - i:04d}"), F.col("_ord.lane"))  # earlier lanes come first in descending order
        df = f.df.withColumn("_ord", F.struct(lane.alias("lane"), F.col("_ord.at").alias("at"), F.col("_ord.id").alias("id")))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        physical |= f.physical
        counts |= f.counts
    return Frame(out, physical, counts)


def paths(frame: Frame, config: dict, conditions: dict[str, dict | None]) -> dict[str, Frame]:
    """Branch id -> its records. ``conditions`` are the branches' own conditions, or those of
    the Filter right behind. Always takes everything; a fallback takes what no branch with
    conditions claims; a branch whose own Filter narrows it passes everything on. Branches
    may overlap."""
    branches = config.get("paths") or []
    claims = [rules(frame, c) for p in branches if p.get("mode", "custom") == "custom" and (c := conditions.get(p["id"])) and c.get("rules")]
    claimed = F.lit(False)
    for c in claims:
        claimed = claimed | c
    rest, out = frame.where(~claimed) if claims else frame, {}
    for p in branches:
        mode, own = p.get("mode", "custom"), p.get("filters") or {}
        out[p["id"]] = rest if mode == "fallback" else frame.where(rules(frame, own)) if mode == "custom" and own.get("rules") else frame
    if config.get("fallbackId"):
        out[config["fallbackId"]] = rest
    return out


# ---- time between two moments ----------------------------------------------------


def _sides(frame: Frame, c: dict) -> DataFrame:
    """Records with their key, and their start and stop moments where their step may give one."""
    key = F.nullif(F.coalesce(field_of(frame, c["keyField"]).text, F.lit("")), F.lit(""))
    of = lambda step, ms: F.when(F.array_contains("_steps", step), ms) if step else ms
    start, stop = of(c.get("startStep"), field_of(frame, c["startField"]).ms), of(c.get("endStep"), field_of(frame, c["endField"]).ms)
    return frame.df.withColumns({"_key": key, "_start": start, "_stop": stop}).where("_key is not null")


def _starts(sides: DataFrame) -> DataFrame:
    """_key, r: the record of the earliest start; ties go to the first record."""
    first = F.struct((-F.col("_start")).alias("at"), "_ord")
    return sides.where("_start is not null").groupBy("_key").agg(F.max_by(_packed(sides, ("_key", "_stop")), first).alias("r"))


def _stops(sides: DataFrame, starts: DataFrame, same: bool) -> DataFrame:
    """_key, at: the earliest stop at or after the start; stops: how many stops could be
    looked at. A record is not its own stop where both moments are one field."""
    begun = starts.select("_key", F.col("r._start").alias("_from"), F.col("r.id").alias("_first"))
    stops = sides.where("_stop is not null").select("_key", "_stop", "id").join(begun, "_key")
    if same:
        stops = stops.where(~F.col("id").eqNullSafe(F.col("_first")))
    return stops.groupBy("_key").agg(F.min(F.when(F.col("_stop") >= F.col("_from"), F.col("_stop"))).alias("_to"), F.count(F.lit(1)).alias("_stops"))


def time_between(frame: Frame, config: dict) -> Frame:
    """Each key's earliest start with the first stop at or after it: the start's record,
    whose subject is the key, with time_between.{key, from_at, to_at, seconds, minutes,
    hours, days}. Keys without such a pair give nothing."""
    sides = _sides(frame, config)
    starts = _starts(sides)
    pairs = starts.join(_stops(sides, starts, config["startField"] == config["endField"]).where("_to is not null"), "_key")
    start, gap = F.col("r._start"), (F.col("_to") - F.col("r._start")).cast("double")
    units = {"seconds": 1_000.0, "minutes": 60_000.0, "hours": 3_600_000.0, "days": 86_400_000.0}
    made = {"key": F.col("_key"), "from_at": iso_ms(start), "to_at": iso_ms(F.col("_to")), **{u: gap / n for u, n in units.items()}}
    kept = [F.col("_key").alias("subject") if c == "subject" else F.col("r")[c].alias(c) for c in frame.df.columns]
    df = pairs.select(*kept, *[v.alias(f"_between_{k}") for k, v in made.items()])
    return replace(frame, df=df, physical={**frame.physical, **{f"time_between.{k}": f"_between_{k}" for k in made}})


def time_between_report(frame: Frame, config: dict) -> DataFrame:
    """keys, started, matched, noStop, stopBeforeStart: one row."""
    sides = _sides(frame, config)
    starts = _starts(sides)
    stops = _stops(sides, starts, config["startField"] == config["endField"])
    keys = sides.select("_key").distinct().join(starts.select("_key", F.lit(True).alias("s")), "_key", "left").join(stops, "_key", "left")
    begun = F.col("s").isNotNull()
    return keys.agg(
        F.count(F.lit(1)).alias("keys"), F.count("s").alias("started"), F.count_if(begun & F.col("_to").isNotNull()).alias("matched"),
        F.count_if(begun & F.col("_stops").isNull()).alias("noStop"), F.count_if(begun & F.col("_stops").isNotNull() & F.col("_to").isNull()).alias("stopBeforeStart"),
    )


def mixed_steps(frame: Frame) -> DataFrame:
    """One row: records came down more than one way."""
    way = F.array_join(F.array_sort("_steps"), ",")
    return frame.df.agg((F.min(way) != F.max(way)).alias("mixed"))
