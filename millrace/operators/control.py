"""Joins and roll-ups over the tables beside the events: connections, their streams and
import jobs, raw payloads, dead letters, deliveries and provider calls.

Tables are DataFrames with these columns, of which each function reads what it names:

- connections: id, source, name, status (active or disabled), disabled_at, paused_until, failures
- streams: id, connection_id, config_hash, status, cursor, created_at, last_polled_at
- jobs: id, stream_id, connection_id, status, target_floor, created_at, started_at, progress_at, rows_imported
- raw: id, connection_id, payload, received_at
- dead: id, raw_id, connection_id, error, created_at, resolved_at
- deliveries: connection_id, status, error, created_at
- calls: connection_id, provider, operation, calls, throttled, observed_limit, window_start
- events: the stored canonical events

Existence is a semi join and its absence an anti join; counts are taken before a join, so
a connection with a third of all events is one row when it meets its streams.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# When a check speaks up.
FAILING_STREAK, THROTTLED_A_DAY, RESTARTS = 5, 20, 3
UNSWEPT_HOURS, STALLED_HOURS, EMPTY_HOURS, LETTER_HOURS, LAG_DAYS = 24, 6, 1, 24, 25


def live(events: DataFrame) -> DataFrame:
    return events.where("deleted_at is null")


def hours_before(now: Column, hours: int) -> Column:
    return now - F.expr(f"interval {hours} hours")


def live_per_connection(events: DataFrame) -> DataFrame:
    """connection_id, live: of every connection with live records."""
    return live(events).groupBy("connection_id").agg(F.count(F.lit(1)).alias("live"))


def live_per_stream(streams: DataFrame, events: DataFrame) -> DataFrame:
    """streams with ``live``: their records that are no tombstones, 0 where there are none."""
    held = live(events).groupBy("connection_id", F.col("stream_hash").alias("config_hash")).agg(F.count(F.lit(1)).alias("live"))
    return streams.join(held, ["connection_id", "config_hash"], "left").withColumn("live", F.coalesce("live", F.lit(0)))


def stream_inventory(streams: DataFrame, connections: DataFrame, events: DataFrame) -> DataFrame:
    """What each stream of each connection holds: live and retired rows, the oldest and newest
    live moment, the latest generation."""
    alive = F.col("deleted_at").isNull()
    held = events.groupBy("connection_id", F.col("stream_hash").alias("config_hash")).agg(
        F.count_if(alive).alias("live_rows"), F.count_if(~alive).alias("retired_rows"), F.min(F.when(alive, F.col("occurred_at"))).alias("oldest_live"), F.max(F.when(alive, F.col("occurred_at"))).alias("newest_live"), F.max("sync_generation").alias("latest_generation")
    )
    named = connections.select(F.col("id").alias("connection_id"), "source", F.col("name").alias("connection"))
    found = streams.select("connection_id", "config_hash", "status", "last_polled_at").join(named, "connection_id").join(held, ["connection_id", "config_hash"], "left")
    return found.select("source", "connection", "config_hash", "status", "last_polled_at", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("live_rows", "retired_rows")], "oldest_live", "newest_live", "latest_generation")


def untagged_live(events: DataFrame, connections: DataFrame) -> DataFrame:
    """source, connection, rows: live records that belong to no stream."""
    held = live(events).where("stream_hash is null").groupBy("connection_id").agg(F.count(F.lit(1)).alias("rows"))
    return held.join(connections.select(F.col("id").alias("connection_id"), "source", F.col("name").alias("connection")), "connection_id").select("source", "connection", "rows")


def unresolved_letters(dead: DataFrame, connections: DataFrame) -> DataFrame:
    """connection_id, name, count of dead letters that nobody has resolved; a connection that is gone is unknown."""
    open_ = dead.where("resolved_at is null").groupBy("connection_id").agg(F.count(F.lit(1)).alias("count"))
    names = connections.select(F.col("id").alias("connection_id"), "name")
    return open_.join(names, "connection_id", "left").select("connection_id", F.coalesce("name", F.lit("Unknown connection")).alias("name"), "count")


def rejecting(deliveries: DataFrame, since: Column) -> DataFrame:
    """connection_id, minutes, last_at, last_error of connections that refused deliveries since then."""
    found = deliveries.where((F.col("status") == "rejected") & (F.col("created_at") >= since)).groupBy("connection_id")
    return found.agg(F.count(F.lit(1)).alias("minutes"), F.max("created_at").alias("last_at"), F.min("error").alias("last_error"))


def throttled(calls: DataFrame, since: Column, least: int = THROTTLED_A_DAY) -> DataFrame:
    """connection_id, provider, throttled, calls where a provider said "too many" often."""
    sums = calls.where(F.col("window_start") >= since).groupBy("connection_id", "provider").agg(F.sum("throttled").alias("throttled"), F.sum("calls").alias("calls"))
    return sums.where(F.col("throttled") >= least)


def observed_limits(calls: DataFrame) -> DataFrame:
    """By provider and operation: the least, largest and most common limit seen (of equally
    common ones the least), samples, connections, and when they were seen."""
    seen = calls.where("observed_limit is not null")
    by = ["provider", "operation"]
    common = seen.groupBy(*by, "observed_limit").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.max(F.struct("n", (-F.col("observed_limit")).alias("least")))["least"].alias("_least"))
    sums = seen.groupBy(*by).agg(F.min("observed_limit").alias("lowest_seen"), F.max("observed_limit").alias("highest_seen"), F.count(F.lit(1)).alias("samples"), F.min("window_start").alias("first_seen"), F.max("window_start").alias("last_seen"))
    users = seen.select(*by, "connection_id").distinct().groupBy(*by).agg(F.count("connection_id").alias("connections"))
    return sums.join(common, by).join(users, by).withColumn("most_common", -F.col("_least")).drop("_least")


def percentiles(df: DataFrame, by: list[str], column: str, wanted: dict[str, float]) -> DataFrame:
    """by and a column for each wanted percentile, interpolated between neighbours. Values are
    counted first and each group's counts are read in order, so no list of values is held."""
    counted = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    steps = counted.withColumns({"_upto": F.sum("_n").over(group.orderBy(column)), "_all": F.sum("_n").over(group)})

    def at(q: float) -> Column:
        place = (F.col("_all") - 1) * q
        value = lambda k: F.min(F.when(F.col("_upto") > k, F.col(column)))
        low, high = value(F.floor(place)), value(F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    return steps.groupBy(*by).agg(*[at(q).alias(k) for k, q in wanted.items()])


def key_census(events: DataFrame, path: str) -> DataFrame:
    """key, occurrences of an object's keys among live records' properties."""
    inner = F.try_variant_get(F.try_parse_json("properties"), path, "map<string,variant>")
    return live(events).select(F.explode(F.map_keys(inner)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("occurrences"))


def key_coverage(raw: DataFrame, key: str) -> DataFrame:
    """total, with_key, oldest_with_key of each connection's payloads, for a key or a key of a key."""
    path = "$" + "".join(f'["{k}"]' for k in key.split("."))
    has = F.try_variant_get(F.try_parse_json("payload"), path, "variant").isNotNull()
    return raw.select("connection_id", "received_at", has.alias("_has")).groupBy("connection_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("_has").alias("with_key"), F.min(F.when(F.col("_has"), F.col("received_at"))).alias("oldest_with_key"))


def first_after(frm: DataFrame, to: DataFrame, within: str) -> DataFrame:
    """key, at -> key, at, first: the first moment of ``to`` with the key in the time after
    each of ``frm``, null where there is none. A key's time is cut into stretches at least as
    long as ``within``, so the answer lies in a row's own stretch or is the first of the
    next one: no key is larger than one stretch of it, and no pair is made that is not a result."""
    span = F.ceil((F.unix_micros(F.expr(f"timestamp'1970-07-01' + interval {within}")) - F.unix_micros(F.expr("timestamp'1970-07-01'"))) * 1.06)  # months differ in length
    stretch = F.floor(F.unix_micros("at") / span).alias("stretch")
    asks = frm.select("key", "at", stretch, F.lit(1).alias("asks"), F.lit(None).cast("timestamp").alias("answer"))
    answers = to.select("key", "at", stretch, F.lit(0).alias("asks"), F.col("at").alias("answer"))
    after = Window.partitionBy("key", "stretch").orderBy(F.col("at").desc(), F.col("asks")).rowsBetween(Window.unboundedPreceding, 0)
    own = asks.unionByName(answers).withColumn("own", F.last("answer", ignorenulls=True).over(after)).where("asks = 1")
    following = answers.groupBy("key", (F.col("stretch") - 1).alias("stretch")).agg(F.min("at").alias("following"))
    found = own.join(following, ["key", "stretch"], "left").withColumn("first", F.coalesce("own", "following"))
    return found.select("key", "at", F.when(F.col("first") <= F.col("at") + F.expr(f"interval {within}"), F.col("first")).alias("first"))


# ---- streams and jobs ------------------------------------------------------------


def usable(connections: DataFrame, now: Column) -> DataFrame:
    """Connections that are active and not paused."""
    return connections.where((F.col("status") == "active") & F.col("disabled_at").isNull() & (F.col("paused_until").isNull() | (F.col("paused_until") < now)))


def runnable_jobs(jobs: DataFrame, connections: DataFrame, now: Column) -> DataFrame:
    """One job of each provider: of those that wait or run, the one without progress for longest."""
    able = connections.where((F.col("status") != "disabled") & (F.col("paused_until").isNull() | (F.col("paused_until") < now))).select(F.col("id").alias("connection_id"), F.col("source").alias("provider"))
    waiting = jobs.where(F.col("status").isin("queued", "running")).join(able, "connection_id")
    since = F.coalesce("progress_at", "started_at", "created_at")
    order = F.struct(since.isNotNull().alias("known"), since.alias("since"), "created_at", "id")
    return waiting.groupBy("provider").agg(F.min_by("id", order).alias("job_id"))


def covering_job(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (stream_id, target_floor) with ``job_id`` of a job that reaches as far back or
    further, the furthest one, null where a new one is needed."""
    useful = jobs.where(F.col("status").isin("queued", "running", "complete", "partial")).groupBy("stream_id").agg(F.min(F.struct("target_floor", "id")).alias("j"))
    joined = wanted.join(useful, "stream_id", "left")
    return joined.select("stream_id", "target_floor", F.when(F.col("j.target_floor") <= F.col("target_floor"), F.col("j.id")).alias("job_id"))


def stream_hash(config: Column, read_only: Collection[str] = ()) -> Column:
    """The identity of a stream's configuration (map of texts): blank settings and those that
    only narrow the read do not count, nor does the order of keys."""
    entries = F.filter(F.map_entries(config), lambda e: (F.trim(F.coalesce(e["value"], F.lit(""))) != "") & ~e["key"].isin(*(read_only or ("",))))
    ordered = F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.trim(e["value"]).alias("value"))))
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    text = F.concat(F.lit("{"), F.array_join(F.transform(ordered, lambda e: F.concat(quoted(e["key"]), F.lit(":"), quoted(e["value"]))), ","), F.lit("}"))
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def referenced_graphs(flows: DataFrame, versions: DataFrame) -> DataFrame:
    """flow_id, graph: every flow's draft and its published version."""
    drafts = flows.where("draft is not null").select(F.col("id").alias("flow_id"), F.col("draft").alias("graph"))
    live_ = versions.join(flows.select(F.col("id").alias("flow_id"), F.col("published").alias("version")), ["flow_id", "version"])
    return drafts.unionByName(live_.select("flow_id", "graph"))


def shown_results(results: DataFrame, flows: DataFrame) -> DataFrame:
    """Stored tiles of published flows, with the flow's name."""
    return results.join(flows.where("published is not null").select(F.col("id").alias("flow_id"), F.col("name").alias("flow")), "flow_id")


def orphans(streams: DataFrame, referenced: DataFrame) -> DataFrame:
    """Streams that are not disabled and that no graph refers to (connection_id, config_hash)."""
    return streams.where("status != 'disabled'").join(referenced, ["connection_id", "config_hash"], "left_anti")


def retire_orphans(events: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    """events, those of the given streams as tombstones."""
    marks = gone.select("connection_id", F.col("config_hash").alias("stream_hash"), F.lit(True).alias("_gone")).distinct()
    at = F.when(F.col("_gone") & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at"))
    return events.join(marks, ["connection_id", "stream_hash"], "left").withColumn("deleted_at", at).select(events.columns)


def retire_ghosts(events: DataFrame, streams: DataFrame, now: Column) -> DataFrame:
    """events, where a connection has streams its polled records without one become tombstones."""
    scoped = streams.select("connection_id", F.lit(True).alias("_scoped")).distinct()
    ghost = F.col("_scoped") & (F.col("sync_generation") >= 1) & F.col("stream_hash").isNull() & F.col("deleted_at").isNull()
    return events.join(scoped, "connection_id", "left").withColumn("deleted_at", F.when(ghost, now).otherwise(F.col("deleted_at"))).select(events.columns)


# ---- retention ---------------------------------------------------------------------


def prunable_raw(raw: DataFrame, connections: DataFrame, dead: DataFrame, before: Column) -> DataFrame:
    """Payloads that may go: older than ``before``, of a connection disabled since before that,
    and not waiting in an unresolved dead letter."""
    off = connections.where(F.col("disabled_at") < before).select(F.col("id").alias("connection_id"))
    waiting = dead.where("resolved_at is null").select(F.col("raw_id").alias("id"))
    return raw.where(F.col("received_at") < before).join(off, "connection_id", "left_semi").join(waiting, "id", "left_anti")


def prunable_tombstones(events: DataFrame, connections: DataFrame, before: Column) -> DataFrame:
    """Tombstones that may go: older than ``before`` and of a connection that is not disabled,
    as a disabled one's are what its restoring lifts."""
    kept = connections.where("status != 'disabled'").select(F.col("id").alias("connection_id"))
    return events.where(F.col("deleted_at") < before).join(kept, "connection_id", "left_semi")


# ---- health ------------------------------------------------------------------------


def invariants(now: Column, connections: DataFrame, streams: DataFrame, jobs: DataFrame, events: DataFrame, dead: DataFrame, deliveries: DataFrame, calls: DataFrame, cursors: DataFrame, mirrors: Collection[str]) -> DataFrame:
    """check, subject, number: a row for everything that is not as it should be.

    ``cursors`` has connection_id and mark, the moment up to which an event log was read;
    ``mirrors`` are the sources whose streams are copies of their whole content."""
    row = lambda df, check, subject, number: df.select(F.lit(check).alias("check"), F.col(subject).cast("string").alias("subject"), number.cast("long").alias("number"))
    on = connections.where((F.col("status") == "active") & F.col("disabled_at").isNull()).select(F.col("id").alias("connection_id"), "source", "paused_until")
    mine = streams.withColumnRenamed("id", "stream_id").join(on, "connection_id")
    cut = hours_before(now, UNSWEPT_HOURS)
    resting = F.coalesce(F.col("paused_until") >= now, F.lit(False))
    unswept = mine.where((F.col("status") != "disabled") & ~resting & (F.coalesce("last_polled_at", "created_at") < cut))
    failing = connections.where((F.col("failures") >= FAILING_STREAK) & F.col("disabled_at").isNull())
    stalled = jobs.where(F.col("status").isin("queued", "running") & (F.coalesce("progress_at", "started_at", "created_at") < hours_before(now, STALLED_HOURS)))
    old = mine.where((F.col("status") == "active") & (F.col("last_polled_at") < hours_before(now, EMPTY_HOURS)) & F.col("source").isin(*mirrors))
    restarts = F.try_variant_get(F.try_parse_json("cursor"), "$.restarts", "long")
    letters = dead.where(F.col("resolved_at").isNull() & (F.col("created_at") < hours_before(now, LETTER_HOURS)))
    behind = cursors.join(on, "connection_id").withColumn("days", F.floor((F.unix_millis(now) - F.unix_millis("mark")) / 86_400_000)).where(F.unix_millis(now) - F.unix_millis("mark") > LAG_DAYS * 86_400_000)
    found = [
        row(unswept, "unswept stream", "stream_id", F.lit(1)),
        row(failing, "failing connection", "id", F.col("failures")),
        row(stalled, "stalled import", "id", F.col("rows_imported")),
        row(live_per_stream(old, events).where("live = 0"), "empty mirror", "stream_id", F.col("live")),
        row(letters.groupBy("connection_id").agg(F.count(F.lit(1)).alias("n")), "unresolved dead letters", "connection_id", F.col("n")),
        row(throttled(calls, hours_before(now, 24)), "throttled connection", "connection_id", F.col("throttled")),
        row(mine.withColumn("restarts", restarts).where(F.col("restarts") >= RESTARTS), "restarting scan", "stream_id", F.col("restarts")),
        row(rejecting(deliveries, hours_before(now, LETTER_HOURS)), "rejecting connection", "connection_id", F.col("minutes")),
        row(behind, "lagging cursor", "connection_id", F.col("days")),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
