"""Personal data: Aho-Corasick finds anchors, local parsers expand and validate spans around them.

Anchors are at-signs, ``://``, digits, plus signs and identifier cues.  An at-sign is expanded to
an e-mail address, ``://`` to a web address, a digit or plus sign to the run of characters that
numbers are written with, in which IP addresses, card numbers and phone numbers are parsed; a cue
to the account number that follows it.  The automaton passes once over a text; the parsers see
only the surroundings of anchors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: Kinds in the order in which spans with one start stand; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
#: Kinds that redaction replaces: a web address alone tells nothing about a person.
PRIVATE = ("email", "ip", "card", "phone", "account")
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "passport")
SCHEMES = ("http", "https", "ftp", "ftps")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBER = re.compile(r"[0-9\x20().+-]*")
NUMERIC = frozenset("0123456789 ().+-")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HOST = re.compile(r"[A-Za-z0-9_~.%:@\[\]-]+(?:[/?#][^\s<>\"'`]*)?")
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]{2,4}){2,8}")
ACCOUNT = re.compile(r"(?:\x20?(?:no|nr|number|num))?\.?\x20?[:#=]?\x20?([A-Z]{0,2}[0-9](?:[\x20-]?[0-9]){5,33})(?![A-Za-z0-9])", re.I)


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign in "@+0123456789":
        found.add_word(sign, (sign if sign == "@" else "number", 1))
    found.add_word("://", ("scheme", 3))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    plain = account.replace(" ", "").upper()
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def numbers(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    for m in IP.finditer(text, start, end):
        if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text, start, end):
        if 12 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    for m in PHONE.finditer(text, start, end):
        if 9 <= len(only_digits(m[0])) <= 15:
            yield "phone", m.start(), m.end()


def account(text: str, at: int) -> tuple[int, int] | None:
    """The account number that follows a cue: an IBAN by its check digits, else six digits or more."""
    skip = re.compile(r"[\x20:#=.]{0,3}").match(text, at).end()
    if m := IBAN.match(text, skip):
        end = m.end()
        while end - skip >= 15:  # the run may have taken in words that follow
            if text[end - 1] != " " and mod97(text[skip:end]):
                return skip, end
            end -= 1
    m = ACCOUNT.match(text, at)
    return m.span(1) if m else None


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by start and then kind."""
    if not text:
        return []
    spans, mailed, numbered = [], 0, 0
    for last, (kind, size) in automaton().iter(text):
        at = last - size + 1
        if kind == "number":
            if at < numbered:
                continue
            start = at
            while start > numbered and text[start - 1] in NUMERIC:
                start -= 1
            numbered = NUMBER.match(text, at).end()
            if numbered - start >= 7:
                spans.extend(numbers(text, start, numbered))
        elif kind == "@":
            start = at
            while start > mailed and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                spans.append(("email", start, mailed := m.end()))
        elif kind == "scheme":
            start = at
            while start and at - start < 5 and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            if text[start:at].lower() in SCHEMES and (m := HOST.match(text, last + 1)):
                end = last + 1 + len(m[0].rstrip(".,;:!?)]}"))
                if end > last + 1:
                    spans.append(("url", start, end))
        elif (not at or not text[at - 1].isalnum()) and (found := account(text, last + 1)):
            spans.append(("account", *found))
    return sorted(set(spans), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Replaces private spans by <KIND>; spans that overlap become one, named by the first."""
    out, at, until = [], 0, 0
    for kind, start, end in spans:
        if kind in PRIVATE:
            if start >= until:
                out += [text[at:start], f"<{kind.upper()}>"]
            at = until = max(until, end)
    return "".join([*out, text[at:]])


def with_pii(docs: DataFrame, *, text: str = "text", redacted: str | None = None) -> DataFrame:
    """Adds ``pii``, an array of (kind, start, end), and if named a column with the redacted text.

    A null text has no spans and stays null when redacted.  Columns of these names are replaced.
    """
    names = ["pii", *([redacted] if redacted else [])]
    kept = [c for c in docs.columns if c not in names or c == text]
    made = [c for c in names if c != text]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            columns, found, clean = list(batch.columns), [], []
            for value in batch.column(at):
                value = value.as_py()
                spans = find(value)
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                if redacted:
                    clean.append(redact(value, spans) if spans else value)
            new = {"pii": pa.array(found, pa.list_(span))}
            if redacted:
                new[redacted] = pa.array(clean, pa.string())
            if redacted == text:
                columns[at] = new[text]
            yield pa.RecordBatch.from_arrays([*columns, *(new[c] for c in made)], names=[*batch.schema.names, *made])

    rows = docs.select(*kept)
    kinds = {"pii": ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])), redacted: StringType()}
    return rows.mapInArrow(scan, StructType([*rows.schema.fields, *(StructField(c, kinds[c]) for c in made)]))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """Every document's base spans, counted and digested, and all its spans.

    A null or empty text has none; rows that repeat keep a row each, a null doc_id stays null; an
    empty table gives no rows.
    """
    found = with_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "pii")
    counts = [counted(F.col("pii"), kind).alias(f"n_{kind}") for kind in BASE]
    base = listed(F.filter("pii", lambda x: x["kind"].isin(*BASE)))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
