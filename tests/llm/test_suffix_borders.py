"""Repeats across the borders of buckets, with an excerpt in hundreds of surroundings."""

import random

import pytest

from brindle.llm import suffix_dedup


@pytest.mark.parametrize("bucket", [37, 400])
def test_an_excerpt_in_many_surroundings(spark, monkeypatch, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    rng = random.Random(bucket)
    made = lambda n, chars="abcdefgh ": "".join(rng.choices(chars, k=n))
    excerpt, line = made(420), made(120)
    texts = [made(rng.randrange(200)) + excerpt[: rng.choice((420, 300, 210))] + made(rng.randrange(200)) for _ in range(300)]
    texts += [made(90, "ab") + line + made(90, "ab") for _ in range(300)]  # too short to repeat but for what stands beside it
    texts += [made(4, "ab") + line + excerpt[100:190] + made(4, "ab") for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.result(docs).orderBy("doc_id").collect()]
    assert got == suffix_dedup.brute(texts)


def test_no_suffix_is_dealt_out_twice_over(spark):
    rng = random.Random(1)
    excerpt = "".join(rng.choices("abcdefgh ", k=420))
    texts = ["".join(rng.choices("xyz ", k=150)) + excerpt + "".join(rng.choices("xyz ", k=150)) for _ in range(400)]
    rows = [(1, k, 100, 0, 100, 1, t[100:300].encode(), t[:100][::-1].encode()) for k, t in enumerate(texts)]
    found = spark.createDataFrame(rows, suffix_dedup.SUFFIX).repartitionByRange(20, "r", "l").mapInArrow(suffix_dedup.sorted_buckets, suffix_dedup.FIRST)
    assert found.where("s IS NULL").count() <= len(texts)
