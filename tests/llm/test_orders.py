"""The order of the cascade, and how often documents are taken."""

import random

from brindle.llm import mixing, rules
from brindle.llm.rules import Rule


def test_a_dear_rule_comes_late_whatever_the_start(spark):
    text = " ".join(f"word{k} goes{k}" for k in range(150))
    docs = spark.createDataFrame([(k, text + ("!" * 300 if k % 2 else "") + str(k)) for k in range(600)], "doc_id int, text string")
    sample = rules.measure(docs).persist()
    dear = Rule("dear", r"length(regexp_replace(sha2(repeat(regexp_replace(text, '(a|e)(.)', '$2$1'), 20), 512), '[0-9]', '')) < 0 OR (length(text) - length(replace(text, '!', ''))) * 5 > n_words")
    cheap = Rule("cheap", "(length(text) - length(replace(text, '!', ''))) * 5 > n_words")
    none = Rule("none", "n_words < 0")
    for order in ((dear, cheap, none), (cheap, none, dear), (none, dear, cheap)):
        names = [r.name for r in rules.cascade(sample, order)]
        assert names.index("cheap") < names.index("dear"), names


def test_selectivity_is_conditional():
    a, b, c = (Rule(x, "true") for x in "abc")
    # b rejects much, but nothing that a leaves; c rejects what a leaves.
    patterns = [(50, (True, True, False)), (10, (False, False, True)), (40, (False, False, False))]
    assert [r.name for r in rules.arranged((a, b, c), [1.0, 1.1, 1.0], patterns)] == ["a", "c", "b"]


def test_inclusion_follows_the_given_probabilities(spark):
    rng = random.Random(3)
    rows = [(None if k % 3 == 0 else k % 40, " ".join(["w"] * rng.choice((3, 12, 60, 300)) + [f"x{k}"]), "a" if k % 2 else "b") for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen, runs = {}, 8
    for run in range(runs):
        for r in mixing.plan(docs, seed=f"s{run}").collect():
            seen.setdefault((r["source"], r["size"]), []).append(r["copies"])
            assert r["copies"] <= 2
    sized = docs.select("source", mixing.sized_words(docs["text"]).alias("size")).withColumn("bits", mixing.bits(mixing.F.col("size")))
    want = {(r["source"], r["bits"]): r["whole"] + r["p"] for r in mixing.expected(sized, mixing.sources(sized)).collect()}
    assert len({round(e, 6) for (s, _), e in want.items() if s == "b"}) > 2  # unequal inside a source
    for (source, size), copies in seen.items():
        e = want[(source, len(bin(size)) - 2)]
        assert abs(sum(copies) / len(copies) - e) < 0.1, (source, size, e, sum(copies) / len(copies))


def test_rows_without_id_are_told_apart(spark):
    docs = spark.createDataFrame([(None, f"some words of row {k}", "a") for k in range(400)] + [(7, "w " * 200, "b")] * 2, "doc_id long, text string, source string")
    rows = [r for r in mixing.plan(docs).collect() if r["source"] == "a"]
    assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 5


def test_clashing_names(spark):
    from brindle.llm import near, simhash

    names = ("_id", "_fp", "_own", "_n", "_copies", "_u", "_source", "_size", "_best", "_root", "k", "fp", "root")
    docs = spark.createDataFrame([(k % 3, "some text here " * 9 + str(k % 3), "a", *range(len(names))) for k in range(6)] + [(None, "x", None, *range(len(names)))], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    for fn in (mixing.mix, simhash.keep_one, near.keep_one):
        got = fn(docs)
        assert got.columns == docs.columns and got.count() > 0
        assert all(r[3:] == tuple(range(len(names))) for r in map(tuple, got.collect()))
