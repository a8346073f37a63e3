"""Personal data by anchor expansion.

An Aho-Corasick automaton walks each text once and reports anchors: at-signs, plus
signs, digits, URL schemes and identifier cues. A deterministic parser for each kind
expands from the anchor to both sides, and validates what it found. No pattern is
searched for across the text.

Spans are code points, end exclusive; within a kind they don't overlap, and the leftmost
wins. Base kinds: email, ip, card, phone. Added: url_login (user:password before the host
of a URL), iban (mod 97) and ssn (after a cue).

Defined results for odd input: a null or empty text has no spans; repeated rows give
repeated results; other columns are ignored or passed through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import text_of

DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | DIGITS
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url_login", "iban", "ssn")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
IBAN_CUES = ("IBAN", "iban", "Iban")
SSN_CUES = ("SSN", "ssn", "Ssn", "social security", "Social Security", "Social security")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in DIGITS:
        a.add_word(d, ("d", 1))
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    for kind, words in (("url", SCHEMES), ("iban", IBAN_CUES), ("ssn", SSN_CUES)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


_AUTOMATON: ahocorasick.Automaton | None = None


def automaton() -> ahocorasick.Automaton:
    """The anchors' automaton, built once in each Python worker."""
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = _automaton()
    return _AUTOMATON


def _run(text: str, i: int, allowed: frozenset[str]) -> int:
    """The end of the run of allowed characters that starts at i."""
    n = len(text)
    while i < n and text[i] in allowed:
        i += 1
    return i


def email_at(text: str, at: int, low: int) -> tuple[int, int] | None:
    """The address around the at-sign, reaching no further left than ``low``."""
    start = at
    while start > low and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (after := _run(text, end + 1, LABEL)) > end + 1:
        end, dots = after, dots + 1
    return (start, end) if dots else None


def quad_at(text: str, start: int) -> int:
    """The end of four runs of digits joined by dots that start here; -1 if there are none."""
    end = _run(text, start, DIGITS)
    for _ in range(3):
        if end >= len(text) or text[end] != "." or (after := _run(text, end + 1, DIGITS)) == end + 1:
            return -1
        end = after
    return end


def number_at(text: str, start: int) -> int:
    """The end of the digits from here on, single spaces or hyphens between them allowed."""
    n, end = len(text), start + 1
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    return end


def phone_at(text: str, plus: int) -> int:
    """The end of a telephone number behind the plus sign; -1 if there is none."""
    if plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
        return -1
    end = _run(text, plus + 2, PHONE)
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return end if end > plus + 3 else -1


def digits_of(part: str) -> str:
    return "".join(c for c in part if c in DIGITS)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_after(text: str, i: int) -> tuple[int, int] | None:
    """An account number close behind the cue: two letters, two digits, 11 to 30 more; mod 97 is 1."""
    n = len(text)
    while i < n and text[i] in " :=#.-":
        i += 1
    start, kept, end = i, [], i
    while i < n and len(kept) < 34:
        if text[i] in ALNUM:
            kept.append(text[i])
            end = i = i + 1
        elif text[i] == " " and i + 1 < n and text[i + 1] in ALNUM and len(kept) % 4 == 0:
            i += 1
        else:
            break
        if 15 <= len(kept) and (i >= n or text[i] not in ALNUM):
            s = "".join(kept).upper()
            if s[:2].isalpha() and set(s[2:4]) <= DIGITS and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1:
                return start, end
    return None


def ssn_after(text: str, i: int) -> tuple[int, int] | None:
    """ddd-dd-dddd within a few characters behind the cue."""
    n = len(text)
    for start in range(i, min(n, i + 12)):
        if text[start] in DIGITS:
            part = text[start : start + 11]
            ok = len(part) == 11 and part[3] == part[6] == "-" and all(part[k] in DIGITS for k in (0, 1, 2, 4, 5, 7, 8, 9, 10))
            whole = start + 11 >= n or text[start + 11] not in DIGITS
            return (start, start + 11) if ok and whole and part[:3] not in ("000", "666") else None
    return None


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind, in order."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    past = dict.fromkeys(KINDS, 0)  # where each kind's next match may start
    for last, (kind, length) in automaton().iter(text):
        i = last - length + 1
        if kind == "d":
            # one digit of a run is enough: both parsers eat the whole run
            if i >= past["card"]:
                past["card"] = end = number_at(text, i)
                if end - i >= 13 and 13 <= len(d := digits_of(text[i:end])) <= 19 and luhn(d):
                    out["card"].append((i, end))
            if i >= past["ip"]:
                end = quad_at(text, i)
                if end < 0:
                    past["ip"] = _run(text, i, DIGITS)
                else:
                    past["ip"] = end
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text[i:end].split(".")):
                        out["ip"].append((i, end))
        elif kind == "@":
            if i >= past["email"] and (span := email_at(text, i, past["email"])):
                out["email"].append(span)
                past["email"] = span[1]
        elif kind == "+":
            if i >= past["phone"] and (end := phone_at(text, i)) > 0:
                past["phone"] = end
                if 9 <= len(digits_of(text[i:end])) <= 15:
                    out["phone"].append((i, end))
        elif kind == "url":
            start = last + 1
            if start >= past["url_login"]:
                end = start
                while end < len(text) and text[end] not in "/?# \t\r\n\"'<>":
                    end += 1
                at = text.rfind("@", start, end)
                if at > start and 0 < text.find(":", start, at) - start < at - start - 1:
                    out["url_login"].append((start, at))
                    past["url_login"] = at
        else:
            parse = iban_after if kind == "iban" else ssn_after
            if i >= past[kind] and (span := parse(text, last + 1)):
                out[kind].append(span)
                past[kind] = span[1]
    return out


def digest(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def masked(text: str, found: dict[str, list[tuple[int, int]]] | None = None) -> str:
    """The text with each span (overlapping ones as one) replaced by the kind in angle brackets."""
    found = find(text) if found is None else found
    spans = sorted((a, -b, k) for k in KINDS for a, b in found[k])
    if not spans:
        return text
    out, pos = [], 0
    for a, b, k in spans:
        if a >= pos:
            out += [text[pos:a], f"<{k.upper()}>"]
        pos = max(pos, -b)
    return "".join([*out, text[pos:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, counts, base_sha256, spans and n_spans."""
    schema = T.StructType([docs.select("doc_id").schema[0], *(T.StructField(f"n_{k}", T.LongType()) for k in BASE), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            found = [find(x) for x in b.column(1).to_pylist()]
            cols = [pa.array([len(f[k]) for f in found], pa.int64()) for k in BASE]
            cols += [pa.array([hashlib.sha256(digest(f, BASE).encode()).hexdigest() for f in found], pa.string())]
            cols += [pa.array([digest(f, KINDS) for f in found], pa.string()), pa.array([sum(map(len, f.values())) for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=schema.names)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of each text replaced and n_chars, where there is one, made to fit. Null texts stay null."""
    names = docs.columns
    at = names.index("text")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            texts = [None if x is None else masked(x) for x in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in names else out
