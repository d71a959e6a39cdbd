"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from brindle.llm import bpe, html_extract, langid, media, mixing, pii, rules, simhash, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, page string, data int, runs int, size int, rank int"
LONG = "the quick brown fox jumps over the lazy dog again " * 3000


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, None, s, None, 7, "x", "y", 1, 2, 3, 4) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def table(spark):
    return docs(spark, (1, "hello world, this is a text", "a"), (2, None, None), (3, "", "b"), (1, "hello world, this is a text", "a"), (None, "no id here", "a"), (5, LONG, "c"), (6, " \n\t ", "b"), (5, "another text", "c"))


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark).limit(0)


CALLS = {
    "bpe": bpe.digests, "media": lambda d: media.read_back(media.store(d)), "pii": pii.digest, "rules": rules.judge, "mixing": mixing.plan,
    "simhash": simhash.components, "suffix": suffix_dedup.remove,
}


@pytest.mark.parametrize("name", CALLS)
def test_one_row_for_each_row(name, table, empty):
    got = [r["doc_id"] for r in CALLS[name](table).select("doc_id").collect()]
    assert sorted(got, key=str) == sorted([1, 2, 3, 1, None, 5, 6, 5], key=str)
    assert CALLS[name](empty).count() == 0


def test_rules_count(table):
    got = {(r["doc_id"], r["n_words"]): r for r in rules.judge(table).collect()}
    assert got[(1, 6)]["base_failed"] and not got[(1, 6)]["kept"]
    assert got[(5, 30000)]["n_repeat_words"] == 30000
    assert got[(2, 0)]["n_dup_lines"] == got[(3, 0)]["n_symbols"] == 0


def test_simhash_edges(table):
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.components(table).collect()}
    assert {c for (d, f), c in got.items() if f == 0} == {2}
    assert simhash.fingerprint("One two") == simhash.fingerprint("one  TWO") != simhash.fingerprint("two one")
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "5", "5", "None"]


def test_mix_keeps_columns(table):
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns
    plan = {(r["doc_id"], r["size"]): r["copies"] for r in mixing.plan(table).collect()}
    n = {}
    for r in mixed.collect():
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    assert n.get(1, 0) == 2 * plan[(1, 6)] and n.get(None, 0) == plan[(None, 3)]


def test_toxicity_edges(spark, table, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.train(table, none)
    assert not any(r["toxic"] for r in toxicity.score(table, chain).collect())
    assert toxicity.reject(table, chain).count() == table.count()
    labels = spark.createDataFrame([(1, 1, None), (1, 1, 0), (1, 0, 1), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(empty, toxicity.train(table, labels)).count() == 0


def test_language_edges(spark, table, empty):
    labelled = table.withColumn("lang", F.lit("en"))
    pages = spark.createDataFrame([(1, None, None), (2, "http://a.example.de/de/x", ""), (3, "", '<html lang="en"><p>hello</p>')], "page_id long, url string, html string")
    got = langid.result(labelled, pages).collect()
    assert len(got) == 11 and {r["lang"] for r in got} == {"en"}
    assert {r["lang"] for r in langid.result(table, pages).collect()} == {"und"}
    assert langid.result(empty, pages.limit(0)).count() == 0


def test_html_edges(spark):
    rows = [
        (1, "http://h.example/a", None), (2, "http://h.example/b", ""), (3, None, "plain <b>te</b>xt &amp; more"),
        (4, "http://s.example/1", "<div>one two three four five six</div><div>unique first words here</div>"), (5, "http://s.example/2", "<div>one two three four five six</div><p>other second words here"),
        (6, "http://s.example/3", "<nav>menu</nav><article><h1>T</h1><p>a<br>b<div class='comments'>no</div><form>no</form></article><footer>f</footer>"), (7, "u", "<article>x<script>if (a<b) {}</script> y<!-- no --> z"),
        (8, "u", "<div class='ad'>buy</div><main>ok &#233; &lt;b&gt;</main>"), (8, "u", "<div class='ad'>buy</div><main>ok &#233; &lt;b&gt;</main>"),
    ]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, page int")
    got = [(r["page_id"], r["text"]) for r in html_extract.extract(pages).orderBy("page_id").collect()]
    assert got == [(1, ""), (2, ""), (3, "plain text & more"), (4, "unique first words here"), (5, "other second words here"), (6, "T a b"), (7, "x y z"), (8, "ok é <b>"), (8, "ok é <b>")]
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_media_columns(spark):
    """Every column but the stored form's against hashlib and zlib."""
    long = (LONG + "é\U0001f600")[5:]
    rows = [(1, "hello world"), (2, None), (3, ""), (4, LONG), (5, long), (6, "a" * 64), (7, "a" * 65), (None, "nul\0 and \n"), (1, "hello world")]
    images = media.store(docs(spark, *((i, t, "s") for i, t in rows)))
    stored = {bytes(r["media"]) for r in images.collect()}
    seen = {}
    for r in media.read_back(images).collect():
        seen.setdefault((r["doc_id"], r["n_bytes"]), []).append(r)
    for i, text in rows:
        raw = (text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        for r in seen[(i, len(raw))]:
            assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            assert (r["media_bytes"], r["media_sha256"]) in {(len(m), hashlib.sha256(m).hexdigest()) for m in stored}
            sums = ":".join(str(sum(payload[k::4])) for k in range(4))
            counts = [payload.count(b) for b in range(256)]
            assert r["feature"].split(":", 1)[1] == f"{sums}:{sum(n > 0 for n in counts)}:{counts.index(max(counts))}"
    assert len(stored) == 7  # equal texts, and the null and the empty one, give equal files
