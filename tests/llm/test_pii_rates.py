"""Recall of each added kind, and false spans, on examples that the fit's generator did not make."""

import random
import string

import pytest

from brindle.llm import pii

WORDS = "the report of our team says that value was seen near this place and later again for all users".split()
HEX = "0123456789abcdef"


def around(r, middle):
    return f"{' '.join(r.choices(WORDS, k=r.randint(0, 8)))} {middle} {' '.join(r.choices(WORDS, k=r.randint(1, 8)))}"


def some(r, chars, n):
    return "".join(r.choices(chars, k=n))


def iban(r):
    body = some(r, string.digits, 18)
    check = 98 - int("".join(str(int(x, 36)) for x in body + "DE00")) % 97
    return f"DE{check:02d}{body}"


TRUE = {
    "ssn": lambda r: r.choice(["SSN: ", "social security number ", "ssn ", "tax id ", "Social Security No. "]) + f"{r.choice([r.randint(1, 665), r.randint(667, 899)]):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}",
    "secret": lambda r: r.choice(["api_key=", "password=", "token=", "secret=", "AWS_KEY="]) + some(r, string.ascii_letters + string.digits, r.randint(20, 60)),
    "ipv6": lambda r: r.choice(["address ", "host ", "from ", "server "]) + ":".join(some(r, HEX, 4) for _ in range(8)),
    "mac": lambda r: r.choice(["mac ", "device ", "address "]) + ":".join(some(r, HEX, 2) for _ in range(6)),
    "handle": lambda r: r.choice(["follow ", "contact ", "user "]) + "@" + some(r, string.ascii_lowercase, 7) + str(r.randint(10, 99)),
    "iban": lambda r: r.choice(["iban ", "account ", "konto "]) + iban(r),
}
FALSE = (
    lambda r: f"ratio={r.random():.9f}",
    lambda r: f"width={r.randint(10**6, 10**8)}px",
    lambda r: "E=mc2squared",
    lambda r: f"part {r.randint(100, 999)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}",
    lambda r: "internationalisation16chars",
    lambda r: f"date=20{r.randint(10, 40)}-05-{r.randint(10, 28)}T10:00:00",
    lambda r: f"path=/usr/{r.choice(WORDS)}/file.txt",
)


@pytest.mark.parametrize("kind", pii.ADDED_KINDS)
def test_recall(kind):
    r = random.Random(77)
    texts = [around(r, TRUE[kind](r)) for _ in range(300)]
    assert sum(kind in pii.added_spans(t, pii.base_spans(t)) for t in texts) >= 0.9 * len(texts)


def test_false_spans():
    """Settings, numbers and long words: a third of the widths at most, next to none of the others."""
    r = random.Random(78)
    rates = []
    for make in FALSE:
        texts = [around(r, make(r)) for _ in range(100)]
        rates.append(sum(bool(pii.added_spans(t, pii.base_spans(t))) for t in texts) / len(texts))
    assert max(rates) <= 0.34 and sum(rates) / len(rates) <= 0.1, rates


def test_a_mac_is_no_ipv6():
    assert pii.redacted("the device 00:1b:44:11:3a:b7 was seen") == "the device [MAC] was seen"
