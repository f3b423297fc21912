"""Provider payloads to canonical events, as Column expressions over one JSON payload.

``normalize`` takes raw payloads (raw_id, connection_id, payload JSON text, received_at,
delivery) and gives event_id, event_type, subject, occurred_at, value, currency and
properties of each event in them. A payload that is no JSON object or array gives an
error instead, so that it can be parked and replayed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.dates import PLAIN_TIME, canonical_date, epoch_date, is_date_hinted, plain_moment
from millrace.functions.values import let, number_text, to_ms, to_number, trimmed

# The keys a webhook's fields are looked for under, and providers' event names.
ID_KEYS = ("id", "event_id", "eventId", "uuid", "ID")
TYPE_KEYS = ("event_type", "eventType", "type", "event")
SUBJECT_KEYS = ("email", "subject", "phone", "contact", "name", "user")
VALUE_KEYS = ("value", "amount", "count", "revenue")
TIME_KEYS = ("occurred_at", "occurredAt", "timestamp", "created_at", "createdAt", "time", "date")
CLOSE_TYPES = {
    "activity.sms.created": "sms_sent", "activity.email.created": "email_sent", "activity.call.created": "call_logged", "activity.call.answered": "call_connected",
    "activity.call.completed": "call_completed", "activity.meeting.scheduled": "meeting_scheduled", "activity.meeting.created": "meeting_logged",
    "activity.meeting.completed": "meeting_held", "lead.created": "lead_created", "opportunity.created": "opportunity_created", "task.completed": "task_completed",
}
CALENDLY_TYPES = {"invitee.created": "booked", "invitee.canceled": "canceled"}
INSTANTLY_TYPES = {"reply_received": "reply"}
INSTANTLY_MAILS = {"1": "email_sent", "2": "reply"}


def part(v: Column, *keys: str) -> Column:
    """A nested value as text; null where it is missing, null or blank."""
    path = "$" + "".join(f'["{k}"]' for k in keys)
    return F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))


def first_text(v: Column, keys: Sequence[str]) -> Column:
    """The first key with a text or number in it; numbers in their plain form."""

    def text(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        return F.when(kind == "STRING", F.nullif(F.try_variant_get(x, "$", "string"), F.lit(""))).when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), let(F.try_variant_get(x, "$", "double"), number_text))

    return F.coalesce(*[let(F.try_variant_get(v, f'$["{k}"]', "variant"), text) for k in keys])


def texts_at(v: Column, keys: Sequence[str]) -> Column:
    """Key -> text of those top-level keys that have a text or number, from one reading of the payload."""

    def text(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        return F.when(kind == "STRING", F.nullif(F.try_variant_get(x, "$", "string"), F.lit(""))).when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), let(F.try_variant_get(x, "$", "double"), number_text))

    wanted = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, x: k.isin(*keys))
    return F.transform_values(wanted, lambda k, x: text(x))


def moment_of(text: Column, name: str) -> Column:
    """The timestamp that a text spells under a date-like name, else null."""

    def spelled(t: Column) -> Column:
        epoch = let(to_number(t), epoch_date) if is_date_hinted(name) else F.lit(None).cast("string")
        return F.coalesce(canonical_date(t, name), epoch)

    return let(text, lambda t: F.when(t.rlike(PLAIN_TIME), plain_moment(t)).otherwise(F.timestamp_millis(let(spelled(t), to_ms))))


def _mapped(c: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c), c)


def content_id(namespace: Column, v: Column) -> Column:
    """An id for content without one: equal payloads (keys in any order) have equal ids. A
    variant keeps an object's keys sorted, so its JSON text is canonical."""
    return F.concat(namespace, F.lit(":"), F.substring(F.sha2(F.to_json(v).cast("binary"), 256), 1, 32))


def _columns(v: Column, event_id: Column, kind: Column, subject: Column, at: Column, value: Column | None = None, currency: Column | None = None, facts: Column | None = None) -> Column:
    """One event. ``facts`` (a struct) are properties worked out of nested ones; they are put beside them."""
    props = F.to_json(v)
    if facts is not None:
        both = F.struct(props.alias("own"), F.to_json(facts, {"ignoreNullFields": "false"}).alias("made"))
        props = let(both, lambda b: F.when(b["own"] == "{}", b["made"]).otherwise(F.concat(F.substring(b["made"], F.lit(1), F.length(b["made"]) - 1), F.lit(","), F.substring(b["own"], 2, 1 << 30))))
    return F.struct(event_id.alias("event_id"), kind.alias("event_type"), subject.alias("subject"), at.alias("occurred_at"), (F.lit(None) if value is None else value).cast("double").alias("value"), (F.lit(None) if currency is None else currency).cast("string").alias("currency"), props.alias("properties"))


def _facts(columns: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(k) for k, c in columns.items()])


def _seen() -> Column:
    return F.col("received_at")


def webhook(v: Column, time_key: str | None = None) -> Column:
    """Any JSON: its fields are found under the usual keys. ``time_key`` names the event time's key, if one was chosen."""
    conn = F.concat(F.lit("webhook:"), F.col("connection_id"))

    def event(texts: Column) -> Column:
        first = lambda keys: F.coalesce(*[F.try_element_at(texts, F.lit(k)) for k in keys])
        delivered = F.when(F.col("delivery").isNotNull(), F.concat(conn, F.lit(":delivery:"), F.col("delivery"), F.lit(":"), F.col("_place").cast("string")))
        event_id = F.coalesce(F.concat(conn, F.lit(":"), first(ID_KEYS)), delivered, content_id(conn, v))
        at = moment_of(first_text_at(v, time_key), time_key.rpartition(".")[2]) if time_key else moment_of(first(TIME_KEYS), "occurred_at")
        value = F.coalesce(*[let(first([k]), to_number) for k in VALUE_KEYS])
        return _columns(v, event_id, F.coalesce(first(TYPE_KEYS), F.lit("webhook.received")), first(SUBJECT_KEYS), F.coalesce(at, _seen()), value)

    return let(texts_at(v, (*ID_KEYS, *TYPE_KEYS, *SUBJECT_KEYS, *VALUE_KEYS, *TIME_KEYS)), event)


def first_text_at(v: Column, path: str) -> Column:
    """The text or number at a path of one or two keys."""
    head, _, tail = path.partition(".")
    return first_text(F.try_variant_get(v, f'$["{head}"]', "variant"), [tail]) if tail else first_text(v, [head])


def close(v: Column) -> Column:
    """A row of the event log, under today's names of what it records."""
    kind = F.concat_ws(".", F.coalesce(part(v, "object_type"), F.lit("object")), F.coalesce(part(v, "action"), F.lit("event")))
    natural = F.coalesce(part(v, "id"), part(v, "date_created"), F.lit("unknown"))
    subject = F.coalesce(*[part(v, "data", k) for k in ("contact_name", "lead_name", "to", "phone")])
    return _columns(v, F.concat_ws(":", F.lit("close"), F.col("connection_id"), natural), _mapped(kind, CLOSE_TYPES), subject, F.coalesce(moment_of(part(v, "date_created"), "date_created"), _seen()))


def calendly(v: Column) -> Column:
    """An invitation delivered by webhook, dated by when its meeting starts."""
    payload = F.try_variant_get(v, "$.payload", "variant")
    natural = F.coalesce(part(v, "payload", "scheduled_event", "uri"), part(v, "payload", "uri"), part(v, "created_at"))
    at = F.coalesce(moment_of(part(v, "payload", "scheduled_event", "start_time"), "start_time"), moment_of(part(v, "created_at"), "created_at"), _seen())
    kind = _mapped(F.coalesce(part(v, "event"), F.lit("calendly.event")), CALENDLY_TYPES)
    return _columns(F.coalesce(payload, F.parse_json(F.lit("{}"))), F.concat_ws(":", F.lit("calendly"), F.col("connection_id"), natural), kind, F.coalesce(part(v, "payload", "email"), part(v, "payload", "name")), at)


def calendly_meeting(v: Column) -> Column:
    """A scheduled meeting that was polled, with flat facts of its host and its booking."""
    gone = part(v, "status") == "canceled"
    host = F.try_variant_get(v, "$.event_memberships[0]", "variant")
    facts = {"meeting_type": part(v, "name"), "host_email": part(host, "user_email"), "host_name": part(host, "user_name"), "booked_at": part(v, "created_at"), "canceled_at": F.when(gone, part(v, "updated_at"))}
    at = F.coalesce(moment_of(part(v, "start_time"), "start_time"), moment_of(F.when(gone, part(v, "updated_at")).otherwise(part(v, "created_at")), "created_at"), _seen())
    event_id = F.concat(F.lit("calendly:"), F.col("connection_id"), F.lit(":"), F.when(gone, "canceled:").otherwise(""), part(v, "uri"))
    return _columns(v, event_id, F.when(gone, "canceled").otherwise("booked"), part(v, "name"), at, facts=_facts(facts))


def instantly(v: Column) -> Column:
    conn = F.concat(F.lit("instantly:"), F.col("connection_id"))
    kind = F.coalesce(part(v, "event_type"), F.lit("instantly.event"))
    event_id = F.coalesce(F.concat_ws(":", conn, F.when(part(v, "email_id").isNotNull(), kind), part(v, "email_id")), conn)
    event_id = F.when(part(v, "email_id").isNull(), content_id(conn, v)).otherwise(event_id)
    return _columns(v, event_id, _mapped(kind, INSTANTLY_TYPES), part(v, "lead_email"), F.coalesce(moment_of(F.coalesce(part(v, "timestamp"), part(v, "timestamp_created")), "timestamp"), _seen()))


def instantly_day(v: Column) -> Column:
    """A campaign's numbers of one day; the campaign's id is beside them."""
    at = moment_of(F.coalesce(part(v, "date"), part(v, "day")), "date")
    day, campaign = F.date_format(at, "yyyy-MM-dd"), part(v, "campaign_id")
    return _columns(v, F.concat_ws(":", F.lit("instantly"), F.col("connection_id"), campaign, F.lit("daily"), day), F.lit("campaign_day"), F.concat_ws(" ", campaign, day), F.coalesce(at, _seen()))


def instantly_totals(v: Column, campaign: str | None = None) -> Column:
    """A campaign's numbers of all time, restated with every reading; no event if ``campaign`` names
    another one, as a provider may answer with other campaigns' rows."""
    own = part(v, "campaign_id")
    at = moment_of(F.coalesce(part(v, "created_at"), part(v, "campaign_created_at")), "created_at")
    made = _columns(v, F.concat_ws(":", F.lit("instantly"), F.col("connection_id"), own, F.lit("totals")), F.lit("campaign_totals"), own, F.coalesce(at, _seen()))
    return F.when(own.isNotNull() & (F.lit(campaign is None) | (own == (campaign or ""))), made)


def instantly_mail(v: Column) -> Column:
    """One mail: a reply is its sender's, a sent one the first receiver's."""
    kind = F.coalesce(part(v, "ue_type"), F.lit("0"))
    receiver = F.nullif(F.trim(F.get(F.split(part(v, "to_address_email_list"), ","), 0)), F.lit(""))
    names = F.create_map(*[F.lit(x) for pair in INSTANTLY_MAILS.items() for x in pair])
    at = moment_of(F.coalesce(part(v, "timestamp_created"), part(v, "timestamp_email")), "timestamp_created")
    return _columns(v, F.concat_ws(":", F.lit("instantly"), F.col("connection_id"), F.lit("email"), part(v, "id")), F.coalesce(F.try_element_at(names, kind), F.lit("email")), F.when(kind == "2", part(v, "from_address_email")).otherwise(receiver), F.coalesce(at, _seen()))


def whop(v: Column, kind: str = "payment") -> Column:
    """A payment (with its amount and currency) or a membership."""
    at = F.coalesce(moment_of(part(v, "paid_at"), "paid_at"), moment_of(part(v, "created_at"), "created_at"), _seen())
    paid = kind == "payment"
    subject = F.coalesce(part(v, "user", "email"), part(v, "user", "username"), part(v, "product", "title"), part(v, "id"))
    return _columns(v, F.concat_ws(":", F.lit("whop"), F.col("connection_id"), part(v, "id")), F.lit(kind), subject, at, to_number(part(v, "total")) if paid else None, F.upper(part(v, "currency")) if paid else None)


def sheet_row(v: Column, date_column: str | None = None) -> Column:
    """A row of a sheet: {"row": number, "cells": {header: cell}}. Its subject is the first
    cell that looks like an address: in the sheet's order where a payload is one row, else by header
    (a variant keeps an object's keys sorted, the payload's text has them as they came)."""
    cells = F.coalesce(F.try_variant_get(v, "$.cells", "variant"), F.parse_json(F.lit("{}")))
    ordered = F.when(F.btrim("payload", F.lit(" \t\r\n")).startswith("{"), F.from_json("payload", "cells map<string,string>")["cells"])
    mails = F.filter(F.map_values(F.coalesce(ordered, F.try_variant_get(cells, "$", "map<string,string>"))), lambda c: c.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"))
    at = moment_of(part(cells, date_column), date_column) if date_column else F.lit(None).cast("timestamp")
    return _columns(cells, F.concat_ws(":", F.lit("gsheets"), F.col("connection_id"), F.lit("row"), part(v, "row")), F.lit("row_added"), F.get(mails, 0), F.coalesce(at, _seen()))


def calendar_event(v: Column) -> Column:
    """A calendar entry with its attendance counted: rooms are no guests, and guests of
    another domain than the organiser's are external."""
    everyone = F.coalesce(F.try_variant_get(v, "$.attendees", "array<variant>"), F.array().cast("array<variant>"))
    text = lambda a, k: F.try_variant_get(a, f"$.{k}", "string")
    guests = F.filter(everyone, lambda a: F.coalesce(text(a, "resource"), F.lit("")) != "true")
    organizer = F.coalesce(part(v, "organizer", "email"), F.get(F.transform(F.filter(guests, lambda a: text(a, "organizer") == "true"), lambda a: text(a, "email")), 0))
    domain = lambda mail: F.nullif(F.lower(F.element_at(F.split(mail, "@"), -1)), F.lit(""))
    status = lambda a: F.coalesce(text(a, "responseStatus"), F.lit("needsAction"))
    many = lambda xs, s: F.size(F.filter(xs, lambda a: a["status"] == s))

    def counted(p: Column) -> Column:
        guests, outside = p["guests"], F.filter(p["guests"], lambda a: a["domain"] != p["domain"])
        return let(F.struct(outside.alias("outside")), lambda o: _facts({
            "guests_total": F.size(guests), "guests_accepted": many(guests, "accepted"), "guests_declined": many(guests, "declined"), "guests_pending": many(guests, "needsAction"),
            "guests_external": F.size(o["outside"]), "guests_external_accepted": many(o["outside"], "accepted"), "is_external_meeting": F.size(o["outside"]) > 0, "organizer_email": p["organizer"], "organizer_domain": p["domain"],
        }))

    # Each guest and the organiser are looked at once; the facts are counts of what was found.
    seen = F.transform(guests, lambda a: F.struct(status(a).alias("status"), domain(text(a, "email")).alias("domain")))
    facts = let(F.struct(seen.alias("guests"), let(organizer, lambda o: F.struct(o.alias("mail"), domain(o).alias("domain"))).alias("by")), lambda p: let(F.struct(p["guests"].alias("guests"), p["by"]["mail"].alias("organizer"), p["by"]["domain"].alias("domain")), counted))
    at = F.coalesce(moment_of(F.coalesce(part(v, "start", "dateTime"), part(v, "start", "date")), "start"), _seen())
    return _columns(v, F.concat_ws(":", F.lit("gcal"), F.col("connection_id"), part(v, "id")), F.lit("calendar_event"), F.coalesce(organizer, part(v, "summary")), at, facts=facts)


#: Source -> its normaliser.
CONNECTORS: dict[str, Callable[..., Column]] = {"webhook": webhook, "close": close, "calendly": calendly, "calendly_meeting": calendly_meeting, "instantly": instantly, "instantly_day": instantly_day, "instantly_totals": instantly_totals, "instantly_mail": instantly_mail, "whop": whop, "gsheets": sheet_row, "google_calendar": calendar_event}


def normalize(raw: DataFrame, source: str, **options) -> tuple[DataFrame, DataFrame]:
    """(events, failures) of raw payloads. An array is as many events as it has elements."""
    parsed = raw.withColumn("_v", F.try_parse_json("payload"))
    if "delivery" not in raw.columns:
        parsed = parsed.withColumn("delivery", F.lit(None).cast("string"))
    kind = F.schema_of_variant("_v")
    good = kind.rlike("^(OBJECT|ARRAY)")
    # A bare element of an array is its value.
    boxed = lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), x).otherwise(F.try_parse_json(F.concat(F.lit('{"value":'), F.to_json(x), F.lit("}"))))
    # Null for all else, which gives no rows; a filter beside it would read each payload once more.
    items = F.when(kind.startswith("OBJECT"), F.array("_v")).when(kind.startswith("ARRAY"), F.transform(F.try_variant_get("_v", "$", "array<variant>"), boxed))
    each = parsed.select("*", F.posexplode(items).alias("_place", "_item"))
    made = each.select(F.col("raw_id").alias("raw_event_id"), "connection_id", "received_at", CONNECTORS[source](F.col("_item"), **options).alias("e"))
    events = made.where("e is not null").select("raw_event_id", "connection_id", "received_at", F.lit(source).alias("source"), "e.*")
    failures = parsed.where(~F.coalesce(good, F.lit(False))).select("raw_id", "connection_id", F.lit(source).alias("source"), "payload", "received_at", F.lit("the payload is no JSON object or array").alias("error"))
    return events, failures


def sheet_cells(rows: DataFrame) -> DataFrame:
    """name, value, ord of every cell of sheet rows (row long, cells map), for date detection."""
    return rows.select(F.col("row").alias("ord"), F.explode("cells").alias("name", "value")).where(trimmed(F.col("name")) != "")
