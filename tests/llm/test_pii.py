import hashlib
import random
import re

import pytest

from almanac.llm import pii
from tests.llm.common import LONG, folder, none, odd

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


@pytest.mark.parametrize("alphabet", ["0123456789.-+ ()@ab", "01. -+", "a.@-b1", "4539578763621486 -+", "12 .ñ@:/ht", "@a."])
def test_base_spans_equal_whole_text_patterns(alphabet):
    rng = random.Random(5)
    for _ in range(5000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert [s for s in pii.find(text) if s[0] in pii.BASE] == base(text)


def test_query_equals_patterns(spark, small, tmp_path):
    for where, rows in ((small, spark.read.parquet(f"{small}/documents.parquet")), (folder(spark, tmp_path, odd(spark)), odd(spark))):
        want = sorted(((r.doc_id, base(r.text or "")) for r in rows.collect()), key=repr)
        got = pii.op7_pii(spark, where).collect()
        listed = [(k, *(sum(s[0] == kind for s in found) for kind in pii.BASE), hashlib.sha256(",".join(f"{k_}:{a}:{b}" for k_, a, b in found).encode()).hexdigest()) for k, found in want]
        assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got), key=repr) == sorted(listed, key=repr)


def test_added_kinds():
    text = "IBAN: DE89 3704 0044 0532 0130 00 and more, account no. 12345678, see https://ex.com/a?b=c). Account of war, iban none"
    found = [(k, text[a:b]) for k, a, b in pii.find(text)]
    assert found == [("account", "DE89 3704 0044 0532 0130 00"), ("account", "12345678"), ("url", "https://ex.com/a?b=c")]
    assert pii.find(LONG) == [] and pii.find("") == [] and pii.find(None) == []


def test_redaction(spark):
    clean = pii.with_pii(odd(spark, extra=["pii"]), redacted="text")
    got = {r.doc_id: r for r in clean.collect()}
    assert got[7].text == "é ü ß 日本 \U0001f600 mail <EMAIL>" and got[2].text is None and got[5].text == LONG
    text = "call +1 (988) 555-2485 or x@y.org, 42.144.35.254; https://a.b/c"
    assert pii.redact(text, pii.find(text)) == "call <PHONE> or <EMAIL>, <IP>; https://a.b/c"
    assert pii.with_pii(none(spark)).count() == 0
