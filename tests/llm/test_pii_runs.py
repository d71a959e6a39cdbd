"""Personal data whose length or form the candidates once had a bound on."""

import random
import string

from brindle.llm import pii


def test_long_secrets_go_to_their_end():
    rng = random.Random(6)
    for n in (30, 64, 65, 90, 128, 300):
        for chars in ("0123456789abcdef", string.ascii_letters + string.digits):
            secret = "".join(rng.choices(chars, k=n))
            assert pii.redacted(f"the api_key={secret} was used") == "the api_key=[SECRET] was used"
            assert pii.redacted(f"the token {secret} was used") == "the token [SECRET] was used"
    key = "".join(rng.choices(string.ascii_letters + string.digits, k=40)) + "+/" + "".join(rng.choices(string.ascii_letters, k=50)) + "=="
    assert pii.redacted(f"password={key}.") == "password=[SECRET]."


def test_compressed_ipv6():
    for address in ("2001:db8::1", "fe80::1", "2001:db8:85a3::8a2e:370:7334", "fe80::1ff:fe23:4567:890a", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"):
        assert pii.redacted(f"the server address {address} answers") == "the server address [IPV6] answers", address
        assert pii.redacted(f"from {address}, then") == "from [IPV6], then", address
    for other in ("std::cout", "a :: b", "1::2::3", "12:30:45", "Add::Face", "1:2:3:4:5:6:7:8::9"):
        assert pii.redacted(f"here {other} stands") == f"here {other} stands"


def test_a_secret_around_a_base_span_goes_whole():
    assert pii.redacted("password=hunter2x@mail.example!zzTOP99 was set") == "password=[EMAIL] was set"
    text = "token=aB3dE5fG7hJ9kL1@mail.example9xQ2wE4rT6y end"
    assert "xQ2wE4" not in pii.redacted(text) and "aB3dE5" not in pii.redacted(text)


def test_digest_columns(spark):
    """Counts and spans of the query against the base patterns and the joined strings."""
    import hashlib

    texts = ["mail a.b@c.org and 10.0.0.1", None, "", "card 4111 1111 1111 1111, call +1 (988) 555-2485", "password=7602ad27cf5550de1c9 é@x a@b.c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.digest(docs).collect():
        text = texts[r["doc_id"]] or ""
        base = pii.base_spans(text)
        joined = ",".join(f"{k}:{a}:{b}" for k in pii.BASE_KINDS for a, b in base[k])
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [len(base[k]) for k in pii.BASE_KINDS]
        spans = [x for x in r["spans"].split(",") if x]
        assert [x for x in spans if x.split(":")[0] in pii.BASE_KINDS] == [x for x in joined.split(",") if x]
        order = [(pii.KINDS.index(x.split(":")[0]), int(x.split(":")[1])) for x in spans]
        assert order == sorted(order)
