import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def checked_luhn(d):
    n = [int(c) for c in d][::-1]
    return (sum(n[::2]) + sum(sum(divmod(2 * x, 10)) for x in n[1::2])) % 10 == 0


def plain(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and checked_luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return out


def base(text):
    return [(s.kind, s.start, s.end) for s in pii.find(text) if s.kind in pii.BASE]


pieces = st.sampled_from(
    ["@", ".", "a", "b.c", "-", "+", "1", "25", "256", "00255", " ", "(", ")", "x@y.z", "4111 1111 1111 1111", "4111111111111111", "+1 (212) 555-0100", "1.2.3.4", "é", "🚨", "%", "_", "\n", "4539148803436467", "@@", "a@b", "..", "--"]
)


@settings(max_examples=1500, deadline=None)
@given(st.lists(pieces, max_size=14).map("".join))
def test_base_spans_equal_the_plain_patterns(text):
    assert base(text) == plain(text)


def test_edge_texts():
    assert pii.find(None) == [] and pii.find("") == []
    assert base("a@b.c@d.e f@g") == [("email", 0, 5)]
    long = "a" * 200_000 + "@" + "1" * 200_000 + "." * 5
    assert base(long) == []
    assert base("9" * 300_000 + " 1.2.3.4")[:1] == [("ip", 300_001, 300_008)]


def test_added_kinds_and_context():
    kinds = lambda t: [s.kind for s in pii.find(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 ok") == ["iban"]
    assert kinds("IBAN DE88 3704 0044 0532 0130 00 ok") == []
    assert kinds("number 078-05-1120") == [] and kinds("SSN 078-05-1120") == ["ssn"]
    near, far = pii.find("call +1 (212) 555-0100"), pii.find("zzzz +1 (212) 555-0100")
    assert near[0].score > far[0].score
    assert pii.redact("mail a@b.co now") == "mail <email> now" and pii.redact(None) is None
