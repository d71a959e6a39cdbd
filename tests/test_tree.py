"""Nested nodes: rows, lookup, count, structure, files."""

import json
import os

import pytest

from brindle.operators import tree
from brindle.sources import documents


def node(name, *below, **more):
    return {"node_id": name, "title": f"t {name}", "summary": "s", "source_locator": "turns:0-1", "start_turn": 0, "end_turn": 1, "text": f"text of {name}", "nodes": list(below)} | more


TREE = [node("a", node("b", node("c"), node("same")), node("d")), node("same", node("e"))]


def flat(spark, nodes=TREE, kind="variant"):
    df = spark.createDataFrame([("doc", json.dumps(nodes)), ("none", "[]"), ("null", None)], "doc_id string, j string")
    return tree.flatten(df.selectExpr("doc_id", "parse_json(j) AS nodes" if kind == "variant" else "j AS nodes"))


@pytest.mark.parametrize("kind", ["variant", "string"])
def test_rows_are_depth_first(spark, kind):
    got = [(r["node_id"], r["parent_id"], r["depth"], r["path"], r["parent_position"]) for r in flat(spark, kind=kind).orderBy("position").collect()]
    assert got == [("a", None, 1, [0], -1), ("b", "a", 2, [0, 0], 0), ("c", "b", 3, [0, 0, 0], 1), ("same", "b", 3, [0, 0, 1], 1), ("d", "a", 2, [0, 1], 0), ("same", None, 1, [1], -1), ("e", "same", 2, [1, 0], 5)]


def test_lookup_count_and_structure(spark):
    rows = flat(spark).cache()
    assert [tuple(r) for r in tree.count(rows).collect()] == [("doc", 7, 3)]
    assert [(r["path"], r["text"]) for r in tree.find(rows, "same").collect()] == [([0, 0, 1], "text of same")]
    assert tree.find(rows, "x").collect() == []
    assert sorted(r["node_id"] for r in tree.below(rows, "b").collect()) == ["b", "c", "same"]
    shown = json.loads(tree.structure(rows).first()["nodes"])
    assert [n["node_id"] for n in shown] == ["a", "same"] and shown[0]["nodes"][0]["nodes"][1]["node_id"] == "same"
    assert "text" not in shown[0] and shown[0]["nodes"][0]["nodes"][0]["nodes"] == []


def test_any_depth(spark):
    deep = node("n0")
    for k in range(1, 300):
        deep = node(f"n{k}", deep)
    assert tree.count(flat(spark, [deep])).first()["depth"] == 300


def test_bad_nodes_raise(spark):
    for bad in ([{"node_id": "x"}], {"a": 1}, [node("a", 5)], [node("a", nodes=None)]):
        with pytest.raises(Exception, match="of doc"):
            flat(spark, bad).collect()


def doc(name, path="s/x.jsonl", nodes=TREE, **more):
    return {"doc_id": name, "doc_name": name, "doc_description": None, "source_family": "transcript", "source_path": path, "turn_count": 2, "text": "é text\n", "nodes": nodes} | more


def test_files_go_round(spark, tmp_path):
    first, second = str(tmp_path / "one"), str(tmp_path / "two")
    os.makedirs(first)
    for name, value in (("a", doc("a b")), ("_hidden", doc("_hidden", nodes=[]))):
        with open(f"{first}/{name}.json", "w") as f:
            json.dump(value, f, indent=4)
    (tmp_path / "one" / "other.txt").write_text("no document")
    docs, nodes = documents.read(spark, first)
    assert nodes.count() == 7 and [r["doc_id"] for r in docs.collect()] == ["_hidden", "a b"]
    documents.write(docs, nodes, second)
    assert sorted(os.listdir(second)) == ["_hidden.json", "a_b.json"]
    with open(f"{second}/a_b.json") as f:
        text = f.read()
    assert json.loads(text) == doc("a b") and text.startswith('{\n  "doc_id": "a b",\n  "doc_name"')
    again = documents.read(spark, second)
    assert [sorted(map(str, x.collect())) for x in again] == [sorted(map(str, x.collect())) for x in (docs, nodes)]


def test_the_last_path_wins(spark, tmp_path):
    kinds = ", ".join(f"{n} {t}" for n, t in documents.FIELDS)
    rows = [("x y", "1", None, "transcript", "a/b", 1, "first"), ("x_y", "2", None, "transcript", "a-b", 1, "last"), ("x y", "3", None, "transcript", "a/a", 1, "no")]
    documents.write(spark.createDataFrame(rows, kinds), flat(spark, []), str(tmp_path))
    documents.write(spark.createDataFrame([("z", "z", "d", "transcript", "p", 1, "t")], kinds), flat(spark, []), str(tmp_path))
    got = {r["doc_id"]: (r["text"], r["doc_description"]) for r in documents.read(spark, str(tmp_path))[0].collect()}
    assert got == {"x_y": ("last", None), "z": ("t", "d")}


def test_bad_files_raise(spark, tmp_path):
    for k, bad in enumerate(["{", json.dumps({"doc_id": "x"}), json.dumps(doc("x") | {"nodes": None}), json.dumps(doc("x", turn_count="many"))]):
        folder = tmp_path / str(k)
        folder.mkdir()
        (folder / "bad.json").write_text(bad)
        with pytest.raises(Exception, match="bad.json"):
            documents.read(spark, str(folder))[0].select("*").collect()
            documents.read(spark, str(folder))[1].collect()
    assert documents.read(spark, str(tmp_path / "missing"))[0].collect() == []


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    kinds = ", ".join(f"{n} {t}" for n, t in documents.FIELDS)
    rows = spark.createDataFrame([(f"d{k}", "n", None, "f", "p", 1, "t") for k in range(8)], kinds)
    bad = rows.withColumn("text", F.when(F.col("doc_id") == "d5", F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception):
        documents.write(bad, flat(spark, []), str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") == []
