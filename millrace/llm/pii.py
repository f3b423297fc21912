"""Personal data by anchor expansion: an Aho-Corasick automaton finds at-signs, plus
signs, digits, schemes and identifier cues in one pass; a deterministic parser then
expands each anchor to the bounds of an email, address, number or account and
validates it.

Kinds, in this order: email, ip, card, phone (whose spans equal the leftmost
non-overlapping matches of their patterns), then what the cues add: address (a URL
that carries a user or a mail address) and account (what a cue names: a key, token or
password with a digit; an IBAN whose check digits hold, with or without spaces; a social
security number of a valid area, group and serial; a passport or account number by its
shape). Added spans give way to base spans they overlap. Offsets are code points, end exclusive.

Cases: null text is empty, and stays null when redacted; repeated rows are each
scanned; an empty table gives an empty result; very long texts are scanned whole in
linear time; other columns are passed through untouched.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("token", "password", "passwd", "secret", "api_key", "api-key", "apikey", "access_key", "iban", "ssn", "passport", "account", "acct")

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ALNUM = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_DOTTED = re.compile(rb"[0-9]+(?:\.[0-9]+){3}").match
_RUN = re.compile(rb"[0-9]+").match
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])+").match
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]").match
_URL = re.compile(rb"[^\s<>\"'\x80-\xff]+").match
_NAMED = re.compile(rb"(?:[ _-]?(?:number|no|id|key|code))?[ \t]{0,4}[:=#]?[ \t]{0,4}[\"']?").match
_SECRET = re.compile(rb"[A-Za-z0-9_+/-][A-Za-z0-9_+/.-]{5,}").match
_IBAN = re.compile(rb"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}").match
_SSN = re.compile(rb"([0-9]{3})([ -]?)([0-9]{2})\2([0-9]{4})(?![A-Za-z0-9])").match
_PASSPORT = re.compile(rb"(?=[A-Z]{0,3}[0-9])[A-Z0-9]{6,9}(?![A-Za-z0-9])").match
_NUMBER = re.compile(rb"[0-9](?:-?[0-9]){5,16}(?![A-Za-z0-9])").match
_KEY_ID = re.compile(rb"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])").match
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


@cache
def anchors():
    """The automaton over ASCII-lower-case bytes read as Latin-1; a payload is (kind, length)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for s in SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for s in CUES:
        a.add_word(s, ("cue", len(s)))
    for s in ("akia", "asia"):
        a.add_word(s, ("key", len(s)))
    a.make_automaton()
    return a


def luhn(digits: bytes) -> bool:
    values = [c - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(_DOUBLED[v] for v in values[1::2])) % 10 == 0


def _email(b: bytes, at: int, free: int) -> tuple[int, int] | None:
    """The local part is the run of its characters up to the at-sign, not before free."""
    start = at
    while start > free and b[start - 1] in _LOCAL:
        start -= 1
    return (start, m.end()) if start < at and (m := _DOMAIN(b, at + 1)) else None


class _Addresses:
    """Addresses of one text. Schemes come in order, and the end of a run and the next at-sign
    and slash are looked for once however many schemes stand before them."""

    def __init__(self, b: bytes):
        self.b, self.end, self.stop, self.seen = b, 0, 0, {b"@": -1, b"/": -1}

    def _next(self, c: bytes, start: int) -> int:
        if 0 <= self.seen[c] < start or self.seen[c] < 0:
            at = self.b.find(c, start)
            self.seen[c] = at if at >= 0 else len(self.b)
        return self.seen[c]

    def __call__(self, start: int, size: int) -> tuple[int, int] | None:
        """A scheme's URL if it names a mail address or a user."""
        if start >= self.end:
            self.end = _URL(self.b, start).end()
            self.stop = start + len(self.b[start : self.end].rstrip(b".,;:!?)]}"))
        rest = start + size
        limit = self.stop if self.b[rest - 1 : rest] == b":" else min(self.stop, self._next(b"/", rest))
        return (start, self.stop) if self._next(b"@", rest) < limit else None


def iban(b: bytes) -> bool:
    """Check digits of an IBAN without spaces: the country and they go last, letters are 10 to 35, modulo 97."""
    return int("".join(str(int(chr(c), 36)) for c in b[4:] + b[:4])) % 97 == 1


def _iban(b: bytes, at: int) -> tuple[int, int] | None:
    """The longest IBAN that begins here; it may be written with spaces, and words may follow it."""
    if (m := _IBAN(b, at)) is None:
        return None
    text = m.group()
    while len(text) >= 15:
        if iban(text.replace(b" ", b"")):
            return (at, at + len(text))
        text = text[: max(text.rfind(b" "), 0)]
    return None


def _account(b: bytes, cue: bytes, at: int) -> tuple[int, int] | None:
    """What the cue that ends at ``at`` names."""
    start = _NAMED(b, at).end()
    if cue == b"iban":
        return _iban(b, start)
    if cue == b"ssn":
        m = _SSN(b, start)
        return m.span() if m and m[1] not in (b"000", b"666") and m[1] < b"900" and m[3] != b"00" and m[4] != b"0000" else None
    if cue == b"passport":
        return m.span() if (m := _PASSPORT(b, start)) else None
    if cue in (b"account", b"acct"):
        return m.span() if (m := _NUMBER(b, start)) else None
    if not any(c in b":=#" for c in b[at:start]):
        return None
    return m.span() if (m := _SECRET(b, start)) and re.search(rb"[0-9]", m.group()) else None


def find(b: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes, by kind then start; kinds are numbered as KINDS."""
    found: list[tuple[int, int, int]] = []
    more: list[tuple[int, int, int]] = []
    email = ip = card = phone = added = 0
    lower, address = b.lower(), _Addresses(b)
    for last, (what, size) in anchors().iter(lower.decode("latin-1")):
        at = last - size + 1
        if what == "digit":
            if at >= card and (m := _CARD(b, at)):
                card, digits = m.end(), m.group().replace(b" ", b"").replace(b"-", b"")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, at, card))
            if at >= ip:
                if m := _DOTTED(b, at):
                    ip = m.end()
                    if all(len(x) <= 3 and int(x or b"0") <= 255 for x in (p.lstrip(b"0") for p in m.group().split(b"."))):
                        found.append((1, at, ip))
                else:
                    ip = _RUN(b, at).end()
        elif what == "at":
            if (span := _email(b, at, email)) is not None:
                email = span[1]
                found.append((0, *span))
        elif what == "plus":
            if at >= phone and (m := _PHONE(b, at)):
                phone = m.end()
                if 8 <= sum(48 <= c <= 57 for c in m.group()) <= 15:
                    found.append((3, at, phone))
        elif at >= added:
            if what == "scheme":
                span = address(at, size)
            elif at and b[at - 1] in _ALNUM:
                span = None
            elif what == "key":
                span = m.span() if (m := _KEY_ID(b, at)) else None
            else:
                span = _account(b, lower[at : last + 1], last + 1)
            if span is not None:
                added = span[1]
                more.append((4 if what == "scheme" else 5, *span))
    if more:
        base = covered(found)  # apart from each other and in order
        starts = [s for _, s, _ in base]
        for kind, start, end in more:
            before = bisect_left(starts, end)
            if not before or base[before - 1][2] <= start:
                found.append((kind, start, end))
    return sorted(found)


def in_points(b: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans in code points."""
    if not spans or b.isascii():
        return spans
    before = np.zeros(len(b) + 1, np.int64)
    np.cumsum((np.frombuffer(b, np.uint8) & 0xC0) != 0x80, out=before[1:])
    return [(k, int(before[s]), int(before[e])) for k, s, e in spans]


def covered(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in order with overlapping ones joined under the first one's kind."""
    out: list[tuple[int, int, int]] = []
    for kind, start, end in sorted(spans, key=lambda x: (x[1], x[0])):
        if out and start < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(end, out[-1][2]))
        else:
            out.append((kind, start, end))
    return out


def redacted(b: bytes, spans: list[tuple[int, int, int]]) -> bytes:
    """b with each span replaced by its kind in angle brackets."""
    parts, done = [], 0
    for kind, start, end in covered(spans):
        parts += [b[done:start], f"<{KINDS[kind].upper()}>".encode()]
        done = end
    return b"".join([*parts, b[done:]]) if spans else b


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: array of (kind, start, end) in code points, by kind then start."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in in_points(b, find(b))] for b in (x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(span))], [id_col, "spans"])

    slim = docs.select(id_col, F.col(text_col).cast("string"))
    return map_arrow(slim, run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in the text replaced by its kind; n_chars, where there is
    such a column, is counted anew."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [None if b is None else redacted(b, find(b)) for b in batch.column(at).cast(pa.binary()).to_pylist()]
        columns = batch.columns
        columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays(columns, names)

    plain = docs.toDF(*names)
    out = map_arrow(plain, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields))
    if "n_chars" in docs.columns:
        out = out.withColumn(names[docs.columns.index("n_chars")], F.length(names[at]).cast(docs.schema["n_chars"].dataType))
    return out.toDF(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans and all spans as text."""
    written_out = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in BASE], F.sha2(written_out(base).cast("binary"), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"))
