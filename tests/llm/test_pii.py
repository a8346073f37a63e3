import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinsieve.llm import pii
from llm.helpers import DOCS, ODD, docs

RX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = {k: [] for k in RX}
    for kind, rx in RX.items():
        for m in re.finditer(rx, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out[kind].append(m.span())
    return out


TEXTS = [
    "mail a.b+c@x-y.co.uk, d@e f@g.h@i.j k@.l @m.n o@p..q", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.4 1.2.3 9.9.9.9", "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111 12",
    "+1 (743) 555-3824 +49-30.123456) +1 +12 +1234 56789 ++1 234 567 890", "+1 4111 1111 1111 1111", "é@b.c x@é.c a@b.cé", "5" * 40, "1.1.1.1-2 3.3.3.3",
]


@pytest.mark.parametrize("text", TEXTS + [t for t in ODD if t is not None])
def test_base_spans_equal_the_patterns(text):
    assert {k: pii.find(text)[k] for k in RX} == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0123456789.+-@() aZé%_", max_size=80))
def test_random_texts(text):
    assert {k: pii.find(text)[k] for k in RX} == brute(text)


def test_added_kinds():
    text = "see https://joe:secret@host.org/x, IBAN: DE89 3704 0044 0532 0130 00. SSN 123-45-6789 iban XX00 1234"
    got = {k: [text[a:b] for a, b in v] for k, v in pii.find(text).items() if v}
    assert got["url_login"] == ["joe:secret"] and got["iban"] == ["DE89 3704 0044 0532 0130 00"] and got["ssn"] == ["123-45-6789"]


def test_masking():
    assert pii.masked("a@b.cd and +1 743 555 3824!") == "<EMAIL> and <PHONE>!"
    assert pii.masked("nothing here") == "nothing here"


def test_queries(spark):
    df = docs(spark, [*TEXTS, *ODD, (None, "a@b.c")], extra=True)
    rows = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert len(rows) == len(TEXTS) + len(ODD) + 1
    for i, t in enumerate(TEXTS):
        b = brute(t)
        said = ",".join(f"{k}:{x}:{y}" for k in RX for x, y in b[k])
        assert rows[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest() and (rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone) == tuple(len(b[k]) for k in RX)
    out = pii.mask_pii(df)
    assert out.columns == df.columns
    by = {r.doc_id: r for r in out.collect()}
    assert by[len(TEXTS)].text is None and by[None].text == "<EMAIL>" and all(r.text is None or r.n_chars == len(r.text) for r in by.values())
    assert pii.find_pii(spark.createDataFrame([], DOCS)).collect() == []
