"""Which fields dynamic records have: inference over a sample, presence over everything,
and a registry that the writer keeps up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.values import number_text, to_ms, to_number

# How deep paths go, how many records are sampled, how many paths are shown, where counting values stops.
MAX_DEPTH, SAMPLE, MAX_PATHS, CARDINALITY = 4, 200, 600, 1_000
#: Fields that a step offers beside those that its graph has saved.
OFFERED = 2_000


def _paths(v: Column, prefix: Column, depth: int) -> Column:
    """array<struct<path, value>> of a JSON object: every key of it and, down to ``depth``
    levels, of the objects in it. Arrays are values. Keys that begin with __ are hidden."""
    keys = F.filter(F.map_entries(F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))), lambda e: ~e["key"].startswith("__"))

    def one(e: Column) -> Column:
        path = F.concat(prefix, e["key"])
        own = F.array(F.struct(path.alias("path"), e["value"].alias("value")))
        return F.concat(own, _paths(e["value"], F.concat(path, F.lit(".")), depth - 1)) if depth > 1 else own

    return F.flatten(F.transform(keys, one))


def flattened(df: DataFrame, *carry: str) -> DataFrame:
    """carry, path, value (variant), kind: a row for every path of every record's properties."""
    rows = df.select(*carry, F.explode(_paths(F.col("properties"), F.lit(""), MAX_DEPTH)).alias("p"))
    return rows.select(*carry, "p.path", "p.value", F.schema_of_variant("p.value").alias("kind"))


def value_text(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), number_text(F.try_variant_get(v, "$", "double"))).when(kind != "VOID", F.to_json(v))


def is_empty(v: Column) -> Column:
    """Null, blank text, [] and {} are empty; 0 and false are not."""
    kind = F.schema_of_variant(v)
    return F.coalesce(kind == "VOID", F.lit(True)) | ((kind == "STRING") & (F.trim(F.try_variant_get(v, "$", "string")) == "")) | F.to_json(v).isin("[]", "{}")


def shown_type(v: Column) -> Column:
    """text, number, date, email, boolean, object, list or unknown."""
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    of_text = F.when(text.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), "email").when(text.rlike(r"^\d{4}-\d{2}-\d{2}") & to_ms(text).isNotNull(), "date").when(to_number(text).isNotNull(), "number").otherwise("text")
    return F.when(kind == "STRING", of_text).when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "object").when(kind == "VOID", "unknown").otherwise("number")


def infer_fields(df: DataFrame, sample: int = SAMPLE, most: int | None = MAX_PATHS) -> DataFrame:
    """path, type, example, populated, container of the newest records' fields (df has
    ``_ord`` and variant properties); fields that are filled come first. ``most`` None: all of them."""
    newest = df.orderBy(F.desc("_ord")).limit(sample)
    rows = flattened(newest, "_ord").withColumns({"empty": is_empty(F.col("value")), "type": shown_type(F.col("value")), "text": value_text(F.col("value"))})
    best = F.struct(~F.col("empty"), "_ord")
    found = rows.groupBy("path").agg(F.max_by("type", best).alias("type"), F.substring(F.max_by("text", best), 1, 300).alias("example"), F.count_if(~F.col("empty")).alias("populated"))
    found = found.withColumn("container", F.col("type").isin("object", "list")).orderBy(F.desc("populated"), "path")
    return found if most is None else found.limit(most)


def presence_by_path(df: DataFrame) -> DataFrame:
    """path, present: how many records have a value there; over every record."""
    return flattened(df).where(~is_empty(F.col("value"))).groupBy("path").agg(F.count(F.lit(1)).alias("present"))


def fields_seen(df: DataFrame, *scope: str) -> DataFrame:
    """scope, path, type, cardinality (values told apart, up to CARDINALITY), seen, sample of a batch."""
    kind = F.col("kind")
    stored = F.when(kind == "STRING", F.when(to_ms(F.try_variant_get("value", "$", "string")).isNotNull() & (F.try_variant_get("value", "$", "string").rlike(r"^\d{4}-\d{2}-\d{2}")), "date").otherwise("string")).when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "VOID", "null").otherwise("number")
    rows = flattened(df, *scope).withColumns({"type": stored, "text": value_text(F.col("value")), "empty": is_empty(F.col("value"))})
    # A null type is shown only where nothing else was seen.
    ranked = F.struct(F.col("type") == "null", "type")
    return rows.groupBy(*scope, "path").agg(
        F.min(ranked)["type"].alias("type"), F.least(F.count_distinct(F.when(~F.col("empty"), F.col("text"))), F.lit(CARDINALITY).cast("long")).alias("cardinality"),
        F.count(F.lit(1)).alias("seen"), F.min("text").alias("sample"),
    )


def merge_registry(known: DataFrame, batch: DataFrame, *scope: str, whole: bool = False) -> DataFrame:
    """The registry after a batch: cardinality is the larger, counts add up, null types give
    way; a batch that is a whole resource retires the fields that it no longer has."""
    old = known.select(*scope, "path", F.struct("type", "cardinality", "seen", "sample").alias("o"))
    new = batch.select(*scope, "path", F.struct("type", "cardinality", "seen", "sample").alias("n"))
    both = new.join(old, [*scope, "path"], "left" if whole else "full")
    o, n = F.col("o"), F.col("n")
    kind = F.when(o["type"].isNull() | (o["type"] == "null"), F.coalesce(n["type"], o["type"])).otherwise(o["type"])
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select(*scope, "path", kind.alias("type"), F.greatest(zero(o["cardinality"]), zero(n["cardinality"])).alias("cardinality"), (zero(o["seen"]) + zero(n["seen"])).alias("seen"), F.coalesce(o["sample"], n["sample"]).alias("sample"))


def offered_fields(loaded: DataFrame, registered: DataFrame, pinned: DataFrame, presence: DataFrame | None = None, most: int = OFFERED) -> DataFrame:
    """path, type, populated, origin of the fields that a step offers, best first.

    loaded: path, type, populated of the records at hand; registered: path, type of the registry; pinned:
    paths that the graph has saved. With presence (path, present: counted over all records of one type)
    a field is offered only if some record has a value; without it a loaded field that is empty is
    offered only if the registry knows it. Pinned fields are exempt from that and from the limit."""
    own = loaded.select("path", F.col("type").alias("own"), "populated")
    known = registered.select("path", F.col("type").alias("known"))
    both = own.join(known, "path", "full").join(pinned.select("path").distinct().withColumn("pin", F.lit(True)), "path", "left")
    is_own, count = F.col("own").isNotNull(), F.nullif(F.col("populated"), F.lit(0).cast("long"))
    if presence is None:
        carried = ~is_own | (F.col("populated") > 0) | F.col("known").isNotNull()
    else:
        both = both.join(presence.select("path", "present"), "path", "left")
        carried, count = F.coalesce("present", F.lit(0)) > 0, F.when(is_own, F.coalesce("present", F.lit(0).cast("long")))
    fields = both.select("path", F.coalesce("own", "known").alias("type"), count.alias("populated"), F.when(is_own, "records").otherwise("registry").alias("origin"), F.coalesce("pin", F.lit(False)).alias("pin"), carried.alias("carried"))
    order = (F.col("origin") != "records", F.desc_nulls_last("populated"), "path")
    others = fields.where("carried and not pin").orderBy(*order).limit(most)
    return fields.where("pin").unionByName(others).orderBy(*order).select("path", "type", "populated", "origin")
