"""Personal data by anchor expansion.

One Aho-Corasick pass over the text finds the anchors: at-signs, scheme marks, plus signs, digits
and identifier cues.  From each anchor a local parser expands to the widest run of characters that
any match through the anchor could use and validates what it finds there:
* email: the local part is the run to the left of the at-sign, the domain is parsed to its right;
* ip, card, phone: the run of digits and number punctuation around the anchor, in which each kind
  is matched leftmost and without overlap, then validated (parts, Luhn, number of digits);
* added to these: `url` (a scheme whose authority carries user information), `iban` (length
  by country and mod 97, anywhere in the line behind the cue), `account` (an identifier with a digit that
  follows a cue such as "account number:", "token =" or "account", in any case).
A run is delimited by characters that no match of its kinds can hold, so matching inside it gives
the matches of the whole text.  Spans are code points, end exclusive, ordered by kind, then start.

Null and empty texts have no spans; repeated rows are handled row by row.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import common as C

KINDS = ["email", "ip", "card", "phone", "url", "iban", "account"]
BASE = KINDS[:4]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NUMBER = frozenset("0123456789+ ().-")
# Possessive forms: none of these repeats can give back a character that helps what follows.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,15}\Z")
AUTHORITY = re.compile(r"[^\s/?#@\"'<>]++@[^\s/?#\"'<>]++")
IBAN = re.compile(r"(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}))")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {c: int(n) for n, codes in (p.split(":") for p in (
    "15:NO|16:BE|18:DK FK FI FO GL NL SD|19:MK SI|20:AT BA EE KZ LT LU MN XK|21:CH HR LI LV|22:BG BH CR DE GB GE IE ME RS VA|"
    "23:AE GI IL IQ OM SO TL|24:AD CZ ES MD PK RO SA SE SK TN VG|25:LY PT ST|26:IS TR|27:BI DJ FR GR IT MC MR SM|"
    "28:AL AZ BY CY DO GT HN HU LB NI PL SV|29:BR EG PS QA UA|30:JO KW MU YE|31:MT SC|32:LC|33:RU").split("|")) for c in codes.split()}
VALUE = re.compile(r"(?:[ \t]{1,3}(?:number|no\.?|id|nr\.?))?(?:[ \t]{0,3}[:=#][ \t]{0,3}|[ \t]{1,3})[\"']?([A-Za-z0-9][A-Za-z0-9-]{4,62}[A-Za-z0-9])(?![A-Za-z0-9-])", re.I)
#: Cues of identifiers, looked for in any case.
CUES = ["account", "acct", "iban", "konto", "compte", "cuenta", "passport", "ssn", "token", "api_key", "password"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789+":
        a.add_word(c, ("number", 1))
    a.add_word("@", ("at", 1))
    a.add_word("://", ("scheme", 3))
    for cue in CUES:
        a.add_word(cue, ("cue", len(cue)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _numbers(text: str, a: int, b: int, out: list) -> None:
    run = text[a:b]
    for m in IP.finditer(run):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((1, a + m.start(), a + m.end()))
    for m in CARD.finditer(run):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, a + m.start(), a + m.end()))
    if "+" in run:
        for m in PHONE.finditer(run):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, a + m.start(), a + m.end()))


def _ibans(text: str, a: int, b: int, out: list) -> None:
    """All valid IBANs between a and b, leftmost first: as long as their country has them, for
    other countries as long as mod 97 allows."""
    done = a
    for m in IBAN.finditer(text, a, b):
        if m.start() < done:
            continue
        at = [i for i in range(*m.span(1)) if text[i] != " "]
        iban, length = m[1].replace(" ", ""), IBAN_LENGTHS.get(m[1][:2])
        for n in [length] if length else range(len(iban), 14, -1):
            if n <= len(iban) and _mod97(iban[:n]):
                done = at[n - 1] + 1
                out.append((5, m.start(), done))
                break


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end) of every span, by kind, then start."""
    out: list[tuple[int, int, int]] = []
    numbers_done = email_done = iban_done = 0
    lower = text.lower() if text.isascii() else text.translate(LOWER)  # both keep every position
    for last, (kind, width) in anchors.iter(lower):
        at = last - width + 1
        if kind == "number":
            if at < numbers_done:
                continue
            a, b = at, at + 1
            while a > numbers_done and text[a - 1] in NUMBER:
                a -= 1
            while b < len(text) and text[b] in NUMBER:
                b += 1
            numbers_done = b
            _numbers(text, a, b, out)
        elif kind == "at":
            a = at
            while a > email_done and text[a - 1] in LOCAL:
                a -= 1
            m = DOMAIN.match(text, at + 1) if a < at else None
            if m:
                email_done = m.end()
                out.append((0, a, email_done))
        elif kind == "scheme":
            m, s = AUTHORITY.match(text, last + 1), SCHEME.search(text, max(0, at - 16), at)
            if m and s:
                out.append((4, s.start(), m.end()))
        else:
            m = VALUE.match(text, last + 1)
            if m and any(c.isdigit() for c in m[1]):
                out.append((6, m.start(1), m.end(1)))
            if lower[at:last + 1] == "iban" and last >= iban_done:
                end = text.find("\n", last)
                iban_done = len(text) if end < 0 else end
                _ibans(text, last + 1, iban_done, out)
    return sorted(set(out))


def _mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


SPANS = "doc_id long, spans array<struct<kind: string, start: int, end: int>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    for batch in C.slices(batches):
        found = [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in find(t, anchors)]
                 for t in C.utf8(C.column(batch, "text")).to_pylist()]
        yield pa.RecordBatch.from_arrays([C.column(batch, "doc_id"), pa.array(found, _TYPE)], names=["doc_id", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, spans)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(_spans, SPANS)
