"""Canonical records: the nine columns every operator sees, how a field path finds its
value in them, and the adapters that give other tables this form.

A ``Frame`` is a lazy DataFrame with the RECORD columns, further physical columns, and

- ``_ord``: a struct whose descending order is the records' order (newest first, then id
  downwards; stacked lanes one after another);
- ``_steps``: the ids of the dataset steps that the record has passed.

Constants among them cost nothing, and what no operator asks for is pruned.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.dates import canonical_date, epoch_date, is_date_hinted
from millrace.functions.values import epoch_ms, iso_ms, let, number_text, to_ms, to_number

Reading = Column | Callable[[], Column]

RECORD = ("id", "source", "eventType", "subject", "occurredAt", "value", "currency", "connectionId", "properties")
STANDARD = ("subject", "source", "eventType", "value", "currency", "occurredAt", "id")
#: The stored table of canonical events.
EVENT_SCHEMA = (
    "id string, event_id string, org_id string, connection_id string, source string, event_type string, subject string, "
    "occurred_at timestamp, received_at timestamp, value decimal(38,10), currency string, properties string, raw_event_id string, "
    "identifiers struct<emails:array<string>,phones:array<string>>, sync_generation int, deleted_at timestamp, stream_hash string"
)


class Field:
    """A field's readings, each built when it is first asked for: its text, its number, its
    moment, and whether the record has such a key at all. ``raw`` is its text without a look at
    dates: equal to the text wherever that is no date."""

    def __init__(self, text: Reading, number: Reading, ms: Reading, exists: Reading, filled: Reading | None = None, raw: Reading | None = None):
        blank = lambda: F.coalesce(F.trim(self.text), F.lit("")) != ""
        self._readings = {"text": text, "number": number, "ms": ms, "exists": exists, "filled": blank if filled is None else filled, "raw": text if raw is None else raw}

    def undated(self) -> Field:
        """The same field for comparisons with texts that are no dates."""
        return Field(self._readings["raw"], **{k: self._readings[k] for k in ("number", "ms", "exists", "filled")})

    def _read(self, name: str) -> Column:
        found = self._readings[name]
        if not isinstance(found, Column):
            found = self._readings[name] = found()
        return found

    @property
    def text(self) -> Column:
        return self._read("text")

    @property
    def number(self) -> Column:
        return self._read("number")

    @property
    def ms(self) -> Column:
        return self._read("ms")

    @property
    def exists(self) -> Column:
        return self._read("exists")

    @property
    def order(self) -> Column:
        """What dates and numbers are ordered by."""
        return F.coalesce(self.number, self.ms.cast("double"))

    @property
    def filled(self) -> Column:
        """The text is not blank."""
        return self._read("filled")


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    #: Property path -> physical column.
    physical: Mapping[str, str] = field(default_factory=dict)
    #: Step id -> one-row DataFrame with the number of records that step gave out.
    counts: Mapping[str, DataFrame] = field(default_factory=dict)

    def where(self, condition: Column) -> Frame:
        return replace(self, df=self.df.where(condition))

    def stamped(self, step: str) -> Frame:
        """The records as they leave a step: they have passed it, and its output count can be asked for."""
        df = self.df.withColumn("_steps", F.array_union("_steps", F.array(F.lit(step))))
        return replace(self, df=df, counts={**self.counts, step: self.df.select(F.count(F.lit(1)).alias("n"))})


def _typed(c: Column, kind: T.DataType) -> Field:
    nothing = lambda t: F.lit(None).cast(t)
    if isinstance(kind, T.StringType):
        return Field(c, lambda: to_number(c), lambda: to_ms(c), F.lit(True))
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        ms = F.unix_millis(c.cast("timestamp"))
        return Field(lambda: iso_ms(ms), nothing("double"), ms, F.lit(True))
    if isinstance(kind, T.BooleanType):
        return Field(c.cast("string"), nothing("double"), nothing("long"), F.lit(True))
    if isinstance(kind, T.IntegralType):
        return Field(c.cast("string"), c.cast("double"), epoch_ms(c.cast("double")), F.lit(True))
    d = c.cast("double")
    return Field(lambda: number_text(d), F.when(F.abs(d) < float("inf"), d), lambda: epoch_ms(d), F.lit(True))


def _bracket(key: str) -> str | None:
    """A JSON path step for any key; None where it has both kinds of quotes."""
    if '"' not in key:
        return f'["{key}"]'
    return f"['{key}']" if "'" not in key else None


def _walk(path: str) -> str | None:
    """$ with a step for each dotted part; numbers are array places."""
    parts = [f"[{p}]" if p.isdigit() else _bracket(p) for p in path.split(".")]
    return None if None in parts else "$" + "".join(parts)


def variant_at(properties: Column, path: str) -> Column:
    """The value at a path: the key that is spelt like the whole path, even if it is JSON
    null, else the value found by walking the path's parts. Null where there is none."""
    flat, walk = _bracket(path), _walk(path)
    tries = [p for p in (flat and "$" + flat, walk if "." in path else None) if p]
    if "." in path and any(p.isdigit() for p in path.split(".")):
        tries.append("$" + "".join(_bracket(p) or "" for p in path.split(".")))  # numbers as keys of objects
    if not tries:  # both kinds of quotes in a key
        return F.try_element_at(F.try_variant_get(properties, "$", "map<string,variant>"), F.lit(path))
    return F.coalesce(*[F.try_variant_get(properties, p, "variant") for p in tries])


def _plain_text(v: Column, depth: int = 2) -> Column:
    """A variant as text: arrays are their elements with commas, objects are named as such."""
    kind = F.schema_of_variant(v)
    scalar = F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "string")).when(kind == "VOID", None)
    scalar = scalar.when(kind.startswith("OBJECT"), "[object Object]")
    if depth:
        joined = lambda: F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(_plain_text(x, depth - 1), F.lit(""))), ",")
        scalar = scalar.when(kind.startswith("ARRAY"), joined())
    return scalar.otherwise(number_text(F.try_variant_get(v, "$", "double")))


def _dynamic(v: Column, name: str) -> Field:
    hinted = is_date_hinted(name)

    def read(body: Callable[[Column], Column], numeric: Callable[[Column], Column], other: Callable[[Column], Column]) -> Column:
        """By kind: texts, numbers, and the rest; v is worked out once."""

        def branch(x: Column) -> Column:
            kind = F.schema_of_variant(x)
            texts = let(F.try_variant_get(x, "$", "string"), body)
            return F.when(kind == "STRING", texts).when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), let(F.try_variant_get(x, "$", "double"), numeric)).otherwise(other(x))

        return let(v, branch)

    # A whole number under a date-like name is the moment it counts to.
    dated = lambda d: F.when(d == F.floor(d), epoch_date(d)) if hinted else F.lit(None).cast("string")
    spelled = lambda raw: F.coalesce(canonical_date(raw, name), raw)
    nothing = lambda kind: lambda x: F.lit(None).cast(kind)
    return Field(
        lambda: read(spelled, lambda d: F.coalesce(dated(d), number_text(d)), _plain_text),
        lambda: read(lambda raw: let(spelled(raw) if hinted else raw, to_number), lambda d: F.when(dated(d).isNull(), d), nothing("double")),
        lambda: read(lambda raw: let(spelled(raw), to_ms), lambda d: F.coalesce(to_ms(dated(d)), epoch_ms(d)) if hinted else epoch_ms(d), nothing("long")),
        v.isNotNull(),
        # How a date is spelled does not matter to this one.
        lambda: F.coalesce(read(lambda raw: F.trim(raw) != "", lambda d: F.lit(True), lambda x: _plain_text(x) != ""), F.lit(False)),
        lambda: read(lambda raw: raw, lambda d: F.coalesce(dated(d), number_text(d)), _plain_text),
    )


def bare(path: str) -> str:
    return path.removeprefix("properties.")


def field_of(frame: Frame, path: str) -> Field:
    """The readings of a field path: a standard name, a physical column, a step's stamp, or a place in the properties."""
    if path in STANDARD:
        return _typed(F.col(path), frame.df.schema[path].dataType)
    rest = bare(path)
    if rest.startswith("__count_"):
        step = rest.removeprefix("__count_")
        passed = F.array_contains("_steps", step)
        n = frame.counts[step].scalar() if step in frame.counts else F.lit(None).cast("long")
        n = F.when(passed, n)
        return Field(n.cast("string"), n.cast("double"), epoch_ms(n.cast("double")), passed)
    if rest.startswith("__passed_"):
        passed = F.array_contains("_steps", rest.removeprefix("__passed_"))
        return Field(F.when(passed, "true"), F.lit(None).cast("double"), F.lit(None).cast("long"), passed)
    if rest in frame.physical:
        name = frame.physical[rest]
        return _typed(F.col(name), frame.df.schema[name].dataType)
    if not rest:
        nothing = F.lit(None)
        return Field(nothing.cast("string"), nothing.cast("double"), nothing.cast("long"), F.lit(False))
    return _property(frame.df.sparkSession.sparkContext.applicationId, rest)


@lru_cache(256)
def _property(application: str, path: str) -> Field:
    """A place in the properties. Its expressions are large and the same in every frame, so they
    are built once in an application."""
    parts = [p for p in path.split(".") if not p.isdigit()]
    return _dynamic(variant_at(F.col("properties"), path), parts[-1] if parts else path)


def within(frame: Frame, path: str, start: float, end: float) -> Column:
    """The moment at path lies in [start, end] (milliseconds; end may be infinite); no moment is not in it.
    On a column of timestamps the bounds are literals, which reach the scan."""
    name = path if path == "occurredAt" else frame.physical.get(bare(path), "")
    if name and isinstance(frame.df.schema[name].dataType, T.TimestampType):
        at = F.col(name)
        low = at >= F.timestamp_millis(F.lit(int(start)))
        return low if end == float("inf") else low & (at < F.timestamp_millis(F.lit(int(end) + 1)))
    ms = field_of(frame, path).ms
    return ms.isNotNull() & (ms >= int(start)) & (F.lit(True) if end == float("inf") else ms <= int(end))


# ---- sources -----------------------------------------------------------------


def frame(df: DataFrame, physical: Mapping[str, str] | None = None) -> Frame:
    """A Frame of a DataFrame with the RECORD columns (properties: variant or JSON text)."""
    if isinstance(df.schema["properties"].dataType, T.StringType):
        df = df.withColumn("properties", F.try_parse_json("properties"))
    at = F.unix_millis(F.col("occurredAt").cast("timestamp"))
    order = F.struct(F.lit("").alias("lane"), at.alias("at"), F.col("id").alias("id"))
    return Frame(df.withColumn("_ord", order).withColumn("_steps", F.array().cast("array<string>")), physical or {})


def records(events: DataFrame) -> DataFrame:
    """Stored canonical events as RECORD columns."""
    return events.select(
        "id", "source", F.col("event_type").alias("eventType"), "subject", F.col("occurred_at").alias("occurredAt"),
        F.col("value").cast("double").alias("value"), "currency", F.col("connection_id").alias("connectionId"), "properties",
    )


@dataclass
class EventStore:
    """Where Get data steps read. Stored events of one organisation, or adapted tables."""

    df: DataFrame
    org: str | None = None
    physical: Mapping[str, str] = field(default_factory=dict)
    #: Source -> its read settings: key -> paths any of which must equal the setting, and event types it applies to.
    settings: Mapping[str, Mapping[str, tuple[tuple[str, ...], tuple[str, ...]]]] = field(default_factory=dict)

    #: Connection -> its source, for steps that name a connection alone.
    sources: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def stored(cls, events: DataFrame, org: str, settings: Mapping | None = None, connections: DataFrame | None = None) -> EventStore:
        """connections: id, source of the organisation's connections (a row for each account)."""
        known = {r["id"]: r["source"] for r in connections.select("id", "source").collect()} if connections is not None else {}
        return cls(events, org, settings=settings or {}, sources=known)

    def scan(self, connection: str | None = None, source: str | None = None, event_type: str | None = None, stream: str | None = None, settings: Mapping[str, str] | None = None) -> Frame:
        """Live records of the organisation and, where named, of one connection, source, event type and stream."""
        df, source = self.df, source or self.sources.get(connection or "")
        if self.org is not None:
            df = df.where((F.col("org_id") == self.org) & F.col("deleted_at").isNull())
            df = df.where(F.col("stream_hash") == stream) if stream else df
            df = records(df)
        for column, wanted in (("connectionId", connection), ("source", source), ("eventType", event_type)):
            if wanted:
                df = df.where(F.col(column) == wanted)
        out = frame(df, self.physical)
        for key, wanted in (settings or {}).items():
            paths, types = self.settings.get(source or "", {}).get(key, ((), ()))
            if not str(wanted).strip() or not paths or (types and event_type and event_type not in types):
                continue
            hit = F.lit(False)
            for p in paths:
                hit = hit | (F.coalesce(field_of(out, p).text, F.lit("")) == str(wanted))
            out = out.where(hit)
        return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Table -> id, source, eventType, subject, occurredAt, value as SQL, and its physical columns.
_TABLES = {
    "events": ("cast(event_id as string)", "'events'", "event_type", "cast(user_id as string)", "cast(ts as timestamp)", "value", ()),
    "orders": ("cast(o_orderkey as string)", "'orders'", "o_orderstatus", "cast(o_custkey as string)", "cast(o_orderdate as timestamp)", "o_totalprice", ("o_orderpriority", "o_custkey", "o_totalprice", "o_orderdate")),
    "lineitem": ("concat_ws('-', l_orderkey, l_linenumber)", "'lineitem'", "l_returnflag", "cast(l_partkey as string)", "cast(l_shipdate as timestamp)", "l_extendedprice", ("l_quantity", "l_discount", "l_tax", "l_linestatus", "l_suppkey", "l_extendedprice")),
    "customer": ("cast(c_custkey as string)", "'customer'", "c_mktsegment", "cast(c_custkey as string)", "timestamp'2000-01-01'", "c_acctbal", ("c_nationkey", "c_name", "c_custkey")),
}


def adapted(spark: SparkSession, sf_dir: str, *names: str) -> EventStore:
    """The driver's tables as one store; each is a source under its own name. Their columns
    keep their types, so filters on them reach the Parquet scan."""
    out, physical = None, {}
    for name in names:
        id_, source, kind, subject, at, value, columns = _TABLES[name]
        props = F.try_parse_json("props") if name == "events" else F.lit(None).cast("variant")
        named = {"id": id_, "source": source, "eventType": kind, "subject": subject, "occurredAt": at, "value": value}
        df = table(spark, sf_dir, name).select(*[F.expr(sql).alias(k) for k, sql in named.items()], F.lit(None).cast("string").alias("currency"), F.lit(name).alias("connectionId"), props.alias("properties"), *columns)
        physical |= {c: c for c in columns}
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return EventStore(out, None, physical)
