"""Handles a record can be joined on: e-mail addresses and phone numbers in one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.values import let

# Parts of field names that hold addresses and numbers.
EMAIL_KEYS = ("email", "email_address", "emailaddress", "contact_email", "lead_email", "to", "from", "subject")
PHONE_KEYS = ("phone", "phone_number", "phonenumber", "mobile", "to_number", "from_number", "number")
#: A key of a JSON text without escapes, with a text as its value; keys that may hold a handle.
_KEY_OF_TEXT, _HOLDS = r'"([^"]*+)"\s*+:\s*+"', f"(?i){'|'.join((*EMAIL_KEYS, *PHONE_KEYS))}"


def normalize_email(raw: Column) -> Column:
    """Trimmed, lower case; null unless an @ stands inside and no white space."""
    v = F.lower(F.trim(raw))
    return F.when(v.contains("@") & ~v.startswith("@") & ~v.endswith("@") & ~v.rlike(r"\s"), v)


def normalize_phone(raw: Column) -> Column:
    """+digits where a plus leads or the number is North American, else its digits; null under seven."""
    v = F.trim(raw)
    digits = F.regexp_replace(v, "[^0-9]", "")
    n = F.length(digits)
    out = F.when(v.startswith("+"), F.concat(F.lit("+"), digits)).when(n == 10, F.concat(F.lit("+1"), digits)).when((n == 11) & digits.startswith("1"), F.concat(F.lit("+"), digits))
    return F.when(n >= 7, out.otherwise(digits))


def identifiers(subject: Column, properties: Column) -> Column:
    """struct<emails, phones> of a subject and the text values of a JSON object's top
    level (properties: variant); sorted, distinct, null where there is none."""
    top = F.coalesce(F.try_variant_get(properties, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    cells = F.concat(
        F.array(F.struct(F.lit("subject").alias("k"), subject.alias("v"))),
        F.transform(F.map_entries(top), lambda e: F.struct(F.lower(e["key"]).alias("k"), text(e["value"]).alias("v"))),
    )
    named = lambda c, keys: c["k"].rlike("|".join(keys))
    listed = lambda xs: let(F.array_sort(F.array_distinct(F.array_compact(xs))), lambda ys: F.when(F.size(ys) > 0, ys))

    def found(texts: Column) -> Column:
        mails = F.transform(F.filter(texts, lambda c: named(c, EMAIL_KEYS) | c["v"].contains("@")), lambda c: normalize_email(c["v"]))
        phones = F.transform(F.filter(texts, lambda c: named(c, PHONE_KEYS)), lambda c: normalize_phone(c["v"]))
        return F.struct(listed(mails).alias("emails"), listed(phones).alias("phones"))

    return let(F.filter(cells, lambda c: c["v"].isNotNull()), found)


def identifiers_of_text(subject: Column, properties: Column) -> Column:
    """identifiers of a JSON text. One without an @, an escape, or a text under one of the keys holds none."""
    none = F.lit(None).cast("array<string>")
    keys = F.array_join(F.regexp_extract_all(properties, F.lit(_KEY_OF_TEXT), 1), '"')
    may = subject.isNotNull() | properties.contains("@") | properties.contains("\\") | keys.rlike(_HOLDS)
    return F.when(may, identifiers(subject, F.try_parse_json(properties))).otherwise(F.struct(none.alias("emails"), none.alias("phones")))
