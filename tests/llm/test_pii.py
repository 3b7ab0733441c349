import random
import re

from loomtext.llm import pii
from helpers import docs, odd_texts

BASE = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                                r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _plain(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == 1 and any(int(p) > 255 for p in m[0].split(".")) or kind == 2 and not (16 <= len(digits) <= 19 and pii.luhn(digits))
                    or kind == 3 and not 8 <= len(digits) <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_plain_matching():
    rng, anchors = random.Random(2), pii.automaton()
    pieces = ["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "10.0.0.255", "1.2.3.256", "a.b@c-d.e", "@", "é", " ", "\n", "x", "+", "0"]
    for i in range(8000):
        text = "".join(rng.choice("12 4.@+-(a)_%x\nб" if i % 2 else pieces) for _ in range(rng.randint(0, 40)))
        assert [s for s in pii.find(text, anchors) if s[0] < 4] == _plain(text), repr(text)


def test_long_runs_take_linear_time():
    text = "1" * 100_000 + " " + "a" * 100_000 + "@" + "b" * 100_000 + " " + "+1" * 20_000
    assert [s for s in pii.find(text, pii.automaton()) if s[0] < 2] == []


def test_added_kinds():
    found = lambda t: [(pii.KINDS[k], t[a:b]) for k, a, b in pii.find(t, pii.automaton()) if k > 3]
    assert found('token = "04dbebab91ab85687d33"') == [("account", "04dbebab91ab85687d33")]
    assert found("Account number: AB-123456.") == [("account", "AB-123456")]
    assert found("IBAN DE89 3704 0044 0532 0130 00") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert found("see ftp://me:secret@host.org/x and https://host.org/a") == [("url", "ftp://me:secret@host.org")]
    assert found("the account of the matter, a token: of thanks") == []


def test_added_kinds_in_running_text():
    found = lambda t: [(pii.KINDS[k], t[a:b]) for k, a, b in pii.find(t, pii.automaton()) if k > 3]
    iban = ("iban", "DE89 3704 0044 0532 0130 00")
    assert found(f"IBAN {iban[1]} BIC COBADEFFXXX") == [iban]
    assert found(f"IBAN {iban[1]} 2024 EUR") == [iban]
    assert found(f"The IBAN of the firm that you will have to pay the whole sum to is {iban[1]} or\nso") == [iban]
    assert found(f"İ iBaN {iban[1]} and GB82 WEST 1234 5698 7654 32 X") == [iban, ("iban", "GB82 WEST 1234 5698 7654 32")]
    assert found(f"IBAN below\n{iban[1]}") == found("IBAN DE88 3704 0044 0532 0130 00 BIC") == []
    assert found("account 12345678 was closed") == [("account", "12345678")]
    assert found("Api_Key = a1b2c3d4") == [("account", "a1b2c3d4")]
    assert found("İ aCCount NO 12-34567") == [("account", "12-34567")]


def test_many_ibans_take_linear_time():
    assert pii.find("iban AB12 " * 20_000, pii.automaton()) == []


def test_documents(spark):
    given = odd_texts() + [(700, "mail me.x@y.org or +49 (0)30 1234567"), (700, "mail me.x@y.org or +49 (0)30 1234567")]
    got = pii.personal_data(docs(spark, given)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, len(r.spans)) for r in got) == sorted(
        (-1 if i is None else i, len(pii.find(t or "", pii.automaton()))) for i, t, *_ in given)
    assert pii.personal_data(docs(spark, [])).count() == 0
