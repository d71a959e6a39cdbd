"""Texts longer than a segment."""

import random

from brindle.llm import suffix_dedup


def test_passages_at_segment_borders(spark):
    rng = random.Random(0)
    made = lambda n: bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz ", k=n))
    border, texts = suffix_dedup.SEGMENT, []
    for shift in (-130, -100, -60, -10, 0, 10, 60, 120):
        # The passage ends, or starts, ``shift`` starts past the border of its document; one copy stands in another.
        for first in (border + shift - 300, border + shift):
            passage = made(500)
            texts += [made(first) + passage + made(border + 3000 - first), made(50) + passage + made(70)]
    docs = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.result(docs).orderBy("doc_id").collect()]
    assert got == suffix_dedup.brute([t.decode() for t in texts])
