import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from millrace.functions.dates import HINTS, MONTHS, canonical_date, detect_date_key, is_date_hinted, normalize_dates, normalized, parse_date
from millrace.functions.identity import identifiers, identifiers_of_text, normalize_email, normalize_phone
from millrace.functions.values import bucket_key, number_text, round6, to_ms, to_number

DAYS = [date(1900, 1, 1), date(1969, 12, 31), date(1999, 9, 9), date(2000, 2, 29), date(2031, 10, 13), date(2100, 12, 30)]
NAMES = [n for n in MONTHS if len(n) > 3]


def spellings(d):
    """Every way to write a day; the month's name in three forms."""
    y, m, n = d.year, d.month, d.day
    for sep in "-/":
        yield from (f"{y}{sep}{m:02}{sep}{n:02}", f"{y}{sep}{m}{sep}{n}")
    short, full = d.strftime("%b"), d.strftime("%B")
    for name in (short, full.upper(), short.lower() + "."):
        ending = "th" if 3 < n < 21 else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")
        yield from (f"{name} {n}, {y}", f"{name} {n:02} {y}", f"{name}  {n}{ending},  {y}", f"{n} {name} {y}", f"{n}{ending} {name}, {y}", f"{n:02}-{name}-{y}")
    yield f"{n:02}.{m:02}.{y}"
    yield from (f"{m}/{n}/{y}", f"{m:02}-{n:02}-{y}")


#: A time of day as it is written behind a day, and its milliseconds.
TIMES = [
    (" 0:00", 0), (" 09:05", 32_700_000), (" 23:59:59", 86_399_000), (" 7:08:09.5", 25_689_500), (" 07:08:09.123456", 25_689_123), (" 12:00 am", 0), (" 12:30 PM", 45_000_000), (" 1:15p.m.", 47_700_000),
    (" 06:00Z", 21_600_000), (" 06:00:30 GMT", 21_630_000), (" 06:00 utc", 21_600_000), (" 06:00 +0130", 16_200_000), (" 06:00-05:00", 39_600_000), (" 11:00 pm -0100", 86_400_000),
]
NO_TIMES = [" 24:00", " 9:5", " 09:60", " 09:00:60", " 13:00 pm", " 0:30 am", " 09:00:00.1234567", " 9h", " Z", " +01:00", " noon", " 09:00 +1", ", 09:00", " 09:00 CET", " 09:00  am"]


def moments():
    """(text, canonical form)"""
    out = [(s, d.isoformat()) for d in DAYS for s in spellings(d)]
    for i, (time, at) in enumerate(TIMES):
        for d in (DAYS[2], DAYS[4]):
            then = datetime(d.year, d.month, d.day) + timedelta(milliseconds=at)
            said = then.strftime("%Y-%m-%dT%H:%M:%S.") + f"{then.microsecond // 1000:03}Z"
            some = list(spellings(d))
            out += [(some[(7 * i + k) % len(some)] + time, said) for k in range(4)] + [(f"{d.isoformat()}T{time.strip()}", said), (f"{d:%a}, {d:%d %b %Y}{time}", said), (f"  {d:%a} {d.day}  {d:%B}. {d.year}{time} ", said)]
    return out


def not_moments():
    day = DAYS[4]
    out = [s + t for t in NO_TIMES for s in list(spellings(day))[::5]]
    out += ["2023-02-29", "2000-02-30", "31/04/2020", "13.13.2013", "0/10/2020", "00-00-2000", "1899-12-31", "12/31/2101", "Apr 31, 2020", "0 May 2000", "32nd May 2000"]  # no such day, or too far away
    out += ["2031-10/13", "2031.10.13", "10-13/2031", "2031-10-13-", "x2031-10-13", "2031-10-13x", "2031-10-13T", "20311013T", "2031-010-13", "10/13/20310"]  # other shapes
    out += ["Octo 13, 2031", "13 Octobre 2031", "Oct13 2031", "Oct-13-2031", "13/Oct/2031", "Oct 13 31", "13, Oct 2031", "Oct 2031", "13 October", "Mon, 13 Oct 2031", "Monday, 13 Oct 2031 10:00"]
    return out + ["", "   ", "tomorrow", "October", "2031", "12:30", "3.1.4", "10.0.0.1", "(020) 7946 0958", "1,234,567", "99.99%", "build-2031-10-13"]


#: Texts that only a date-like name makes dates.
HINTED = [("20000229", "2000-02-29"), ("19991332", None), ("946684800", None), ("1000000000", "2001-09-09T01:46:40.000Z"), ("1000000000123", "2001-09-09T01:46:40.123Z"), ("0999999999", "2001-09-09T01:46:39.000Z"), ("10/13/31", "2031-10-13"), ("13.10.70", "1970-10-13"), ("9-8-69 07:00", "2069-09-08T07:00:00.000Z"), ("123456789012", None)]


def test_parse_date():
    for text, wanted in moments():
        assert parse_date(text) == wanted == parse_date(text, "due"), text
    for text in not_moments():
        assert parse_date(text) is None, text
    for text, wanted in HINTED:
        assert parse_date(text, "starts_on") == wanted and parse_date(text, "price") is None, text


def test_month_names():
    assert all(parse_date(f"3 {n} 2010") == f"2010-{MONTHS[n]:02}-03" for n in MONTHS) and len({MONTHS[n] for n in NAMES}) == 11


def test_numbers_need_a_name():
    assert parse_date(1200000000, "created_at") == "2008-01-10T21:20:00.000Z" == parse_date(1200000000000, "createdAt")
    assert [parse_date(x, n) for x, n in ((42, "created_at"), (7.5, "created_at"), (1200000000, "points"), (None, ""), (True, ""), ({}, ""))] == [None] * 6


def test_column_agrees_with_python(spark):
    texts = [t for t, _ in moments()] + not_moments() + [t for t, _ in HINTED] + [None]
    r = random.Random(3)
    for t in [t for t, _ in moments()][::3]:  # and what is nearly a date
        x = list(t)
        for _ in range(r.randint(1, 2)):
            x[r.randrange(len(x))] = r.choice(["", " ", "-", "/", ".", ",", ":", "T", "p", "1", "9", "\t"])
        texts.append("".join(x))
    for name in ("", "due"):
        df = spark.createDataFrame([(t, parse_date(t, name)) for t in texts], "t string, w string")
        assert df.withColumn("g", canonical_date(F.col("t"), name)).where("not (g <=> w)").collect() == []


def test_hints():
    """A name is date-like by one of its words, whatever joins them, and not by a part of a word."""
    for w in HINTS:
        assert is_date_hinted(w) and is_date_hinted(f"user_{w}") and is_date_hinted(f"user{w.title()}") and is_date_hinted(f"{w.upper()} of birth")
        assert not is_date_hinted(f"zz{w}zz") and not is_date_hinted(f"zz{w}")
    assert not any(map(is_date_hinted, ("", "amount", "state", "rate_plan", "Sunday", "format", "option")))


def test_normalized_is_deep_and_idempotent(spark):
    doc = {"a": "9/8/2011", "b": {"c": ["3 Mar 2012", 7]}, "__x": "9/8/2011", "created_at": 1200000000}
    once = normalized(doc)
    assert once == {"a": "2011-09-08", "b": {"c": ["2012-03-03", 7]}, "__x": "9/8/2011", "created_at": "2008-01-10T21:20:00.000Z"}
    assert normalized(once) == once
    df = spark.createDataFrame([('{"a":"9/8/2011"}',), ("not json 1",), (None,)], "p string")
    assert [r[0] for r in df.select(normalize_dates("p")).collect()] == ['{"a":"2011-09-08"}', "not json 1", "{}"]


def test_detect_date_key(spark):
    rows = [(p, v, i) for i in range(4) for p, v in (("data.created_at", "2026-01-05"), ("updated_at", "2026-01-06"), ("note", "2026-01-06"), ("closed", "yes"))]
    got = detect_date_key(spark.createDataFrame(rows, "name string, value string, ord int")).first()
    assert (got["key"], got["tier"]) == ("data.created_at", "creation")


def test_scalars(spark):
    d = spark.createDataFrame([(x,) for x in (10.0, 100.5, 1e7, 12345678.5, 1e21, 1e-7, 1.5e300, 0.1 + 0.2, 1e20, 1e-6, -0.0, -2.5)], "d double")
    assert [r[0] for r in d.select(number_text(F.col("d"))).collect()] == ["10", "100.5", "10000000", "12345678.5", "1e+21", "1e-7", "1.5e+300", "0.30000000000000004", "100000000000000000000", "0.000001", "0", "-2.5"]
    assert [r[0] for r in d.select(round6(F.col("d") * 1e-6)).collect()][-1] == -0.000002  # halves go up
    s = spark.createDataFrame([(x,) for x in ("42", " 42 ", "1e3", "1d", "Infinity", "NaN", "0x10", "+5", ".5", "5.", "", "0b11", None)], "s string")
    assert [r[0] for r in s.select(to_number(F.col("s"))).collect()] == [42, 42, 1000, None, None, None, 16, 5, 0.5, 5, None, 3, None]
    m = spark.createDataFrame([(x,) for x in ("42", "12.5", "1750000000", "1750000000000", "2026-01-01", "2026-01-01T02:00:00+0200", "no")], "s string")
    assert [r[0] for r in m.select(to_ms(F.col("s"))).collect()] == [None, None, 1750000000000, 1750000000000, 1767225600000, 1767225600000, None]
    week = spark.createDataFrame([(1798761600000,)], "m long").select(bucket_key(F.col("m"), "week"), bucket_key(F.col("m"), "quarter")).first()
    assert tuple(week) == ("2026-W53", "2027-Q1")


def test_identity(spark):
    df = spark.createDataFrame([("  Alice@Acme.COM ", "(555) 123-4567"), ("x", "+44 20 7946 0958"), ("@a", "n/a"), (None, "123456")], "m string, p string")
    assert [tuple(r) for r in df.select(normalize_email(F.col("m")), normalize_phone(F.col("p"))).collect()] == [("alice@acme.com", "+15551234567"), (None, "+442079460958"), (None, None), (None, None)]
    got = df.limit(1).select(identifiers(F.col("m"), F.parse_json(F.lit('{"mobile":"5551234567","n":5,"to":"b@c.d","from":"B@c.d","x":null}'))).alias("i")).first()["i"]
    assert (got["emails"], got["phones"]) == (["alice@acme.com", "b@c.d"], ["+15551234567"])


def test_identifiers_of_a_text(spark):
    """The search before the reading passes over no handle."""
    texts = ['{"a":":","email":"b@c.d"}', '{"y":[":"],"Mobile" : "5551234567"}', '{"e\\u006dail":"Q@r.s"}', '{"x":"5551234567","phone_2":"5551234568"}', '{"guests_total":0,"organizer_email":null,"id":"204697"}', '{"note":"v@w.x"}', '{"k":{"email":"no"}}', "no json", "{}", None]
    df = spark.createDataFrame([(s, t) for t in texts for s in (None, "s@t.u")], "s string, t string")
    rows = df.select(identifiers_of_text(F.col("s"), F.col("t")).alias("got"), identifiers(F.col("s"), F.try_parse_json("t")).alias("wanted"), F.col("s").isNull().alias("bare")).collect()
    assert [r["got"] for r in rows] == [r["wanted"] for r in rows]
    assert [(r["got"]["emails"], r["got"]["phones"]) for r in rows if r["bare"]][:4] == [(["b@c.d"], None), (None, ["+15551234567"]), (["q@r.s"], None), (None, ["+15551234568"])]
