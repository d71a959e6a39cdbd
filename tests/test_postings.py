"""Searches over stored lists against the searches that read every row."""

import random

import pytest

from brindle.functions import text as T
from brindle.operators import kb, postings, transcript

WORDS = ["alpha", "beta", "gamma", "delta", "für", "家庭", "x2", "archive"]


def notes(spark, n=300, seed=5):
    r = random.Random(seed)
    some = lambda k: " ".join(r.choice(WORDS) for _ in range(r.randint(0, k)))
    rows = [(f"{r.choice(['archive/', '', 'alpha/'])}n{k // 3}.md", k, k + 1, some(3), some(40)) for k in range(n)]
    return spark.createDataFrame(rows, "path string, line_start int, line_end int, heading_path string, normalized_body string")


def stored(spark, tmp_path, rows, make):
    postings.numbered(rows).write.parquet(str(tmp_path / "nodes"))
    nodes = spark.read.parquet(str(tmp_path / "nodes"))
    postings.write(make(nodes), str(tmp_path / "lists"))
    return nodes, spark.read.parquet(str(tmp_path / "lists"))


def test_notes(spark, tmp_path):
    nodes, lists = stored(spark, tmp_path, notes(spark), postings.of_notes)
    plain = notes(spark)
    plain.cache()
    for query, limit in (("alpha", 5), ("beta alpha", 1), ("beta alpha", 60), ("alpha beta gamma delta", 5), ("家庭 für", 60), ("alpha alpha beta", 5), ("archive", 5), ("nothing", 5), ("alpha nothing", 1), ("?!", 5), ("x2 archive n7", 60)):
        assert postings.search_notes(nodes, lists, query, limit).collect() == kb.search(plain, query, limit).collect(), (query, limit)
    assert postings.search_notes(nodes, lists, "alpha", 0).collect() == []


def test_a_search_reads_the_folders_of_its_terms(spark, tmp_path):
    _, lists = stored(spark, tmp_path, notes(spark), postings.of_notes)
    own = postings.lists(lists, ["alpha"])
    scan = next(x for x in own._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in x)
    number = postings.buckets_of(spark, ["alpha"], postings.BUCKETS)
    assert f"bucket#" in scan and str(number[0]) in scan and "PushedFilters: [IsNotNull(term), EqualTo(term,alpha)]" in scan.replace("In(term, [alpha])", "EqualTo(term,alpha)")
    folders = [p for p in (tmp_path / "lists").iterdir() if p.name.startswith("bucket=")]
    assert len(folders) > 5 and {r["bucket"] for r in own.select("bucket").distinct().collect()} == set(number)


def test_counts_are_capped(spark):
    rows = spark.createDataFrame([("a a a a a/b.md", 1, 2, "a", "b b")], "path string, line_start int, line_end int, heading_path string, normalized_body string")
    got = {(r["kind"], r["term"], r["n"]) for r in postings.unpacked(postings.of_notes(postings.numbered(rows))).collect()}
    assert got == {("h", "a", 1), ("a", "a", T.TERM_CAP), ("a", "b", 1), ("a", "md", 1), ("b", "b", 2)}


def test_transcripts(spark, tmp_path):
    r = random.Random(9)
    made = lambda: "".join(r.choice("abAB12 -.é") for _ in range(r.randint(0, 60)))
    rows = spark.createDataFrame([(f"d{k % 9}", f"{k:06d}", made(), made(), "turns:0-1", 0, 1, made()) for k in range(200)], "doc_id string, node_id string, title string, summary string, source_locator string, start_turn int, end_turn int, text string")
    docs = spark.createDataFrame([(f"d{k}", f"p{k}") for k in range(9)], "doc_id string, source_path string")
    nodes, lists = stored(spark, tmp_path, rows, postings.of_transcripts)
    for query, limit in (("aba", 3), ("ABA bab", 500), ("abab 1212 zzz", 500), ("ab", 3), ("abab ab", 500), ("x", 3), ("", 3), ("d4", 500), ("turn", 500)):
        assert postings.search_transcripts(docs, nodes, lists, query, limit).collect() == transcript.query(docs, nodes, query, limit).collect(), (query, limit)


@pytest.mark.parametrize("make", [postings.of_notes, postings.of_transcripts])
def test_empty(spark, tmp_path, make):
    source = notes(spark).limit(0) if make is postings.of_notes else spark.createDataFrame([], "doc_id string, node_id string, title string, summary string, text string")
    assert make(postings.numbered(source)).collect() == []


def test_a_block_of_nodes_has_one_row_for_each_term(spark, monkeypatch):
    import pyarrow as pa

    rows = postings.numbered(notes(spark, 60).coalesce(1))
    table = postings.of_notes(rows)
    assert table.groupBy("term").count().where("count > 1").isEmpty()
    words = [" für ² x", "x x x x", None, "", "  "]
    batch = pa.RecordBatch.from_pydict({"node": pa.array([7, 8, 9, 10, 11]), "facts": pa.array([0, 16, 0, 0, 0]), "h": pa.array([""] * 5), "a": pa.array(["p"] + [""] * 4), "b": words})
    whole = [r for b in postings.listed(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(postings, "BLOCK", 1)
    alone = [r for b in postings.listed(iter([batch])) for r in b.to_pylist()]
    flat = lambda rs: sorted((r["term"], n, f) for r in rs for n, f in zip(r["nodes"], r["facts"]))
    one = postings.FILES * 32
    assert flat(whole) == flat(alone) == [("für", 7, one + 9), ("p", 7, one + 5), ("x", 7, one + 9), ("x", 8, 2 * one + 16 + 11), ("²", 7, one + 9)]
    assert len(whole) == 4 and len(alone) == 5


def test_an_index_with_lists_of_an_earlier_form(spark, tmp_path):
    from brindle.plans import kb_index

    notes(spark, 30).write.parquet(str(tmp_path / "nodes"))
    spark.createDataFrame([("alpha", 1, 1, 0)], "term string, node long, facts long, bucket int").write.partitionBy("bucket").parquet(str(tmp_path / "postings"))
    assert kb_index._search(spark, str(tmp_path), "alpha beta", 5).collect() == kb.search(notes(spark, 30), "alpha beta", 5).collect()


def test_facts_fit_in_an_integer():
    import pyarrow as pa

    at = (postings.FILES - 1) * 32 + 16
    batch = pa.RecordBatch.from_pydict({"node": pa.array([1]), "facts": pa.array([at]), "h": [""], "a": [""], "b": ["t " * 10000]})
    (row,) = next(postings.listed(iter([batch]))).to_pylist()
    assert row["facts"] == [100 * postings.FILES * 32 + at + 8 + 3]
    assert next(postings.listed(iter([batch]))).schema.field("facts").type == pa.list_(pa.int32())
    assert 32767 * postings.FILES * 32 + at + 15 < 2**31
