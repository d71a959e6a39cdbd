import json

import pytest

from pyspark.sql import functions as F

from brindle.operators import transcript
from brindle.plans import transcript_index
from brindle.sources import files


def turns(spark, *rows):
    made = [("d", "s/d.jsonl", role, text, k, n > 0, n) for k, (role, text, n) in enumerate(rows)]
    return spark.createDataFrame(made, "doc_id string, source_path string, role string, text string, turn_index int, has_tool_use boolean, tool_call_count int")


def test_exchanges_and_summaries(spark):
    t = turns(spark, ("assistant", "hello", 0), ("user", "Q one\nmore", 0), ("assistant", "", 2), ("assistant", "A", 1), ("user", "", 0), ("user", "Q two", 0))
    got = [(r["node_id"], r["title"], r["summary"], r["source_locator"], r["text"]) for r in transcript.nodes(t).orderBy("node_id").collect()]
    assert got == [
        ("000001", "hello", "0 user text turn(s), 1 assistant text turn(s)", "turns:0-0", "Assistant: hello"),
        ("000002", "Q one", "1 user text turn(s), 1 assistant text turn(s), 3 tool call(s)", "turns:1-3", "User: Q one\nmore\n\nAssistant: <2 tool call(s)>\n\nAssistant: A"),
        ("000003", "<empty turn>", "0 user text turn(s), 0 assistant text turn(s)", "turns:4-4", "User: "),
        ("000004", "Q two", "1 user text turn(s), 0 assistant text turn(s)", "turns:5-5", "User: Q two"),
    ]


def test_query_counts_repeated_terms_and_matches_substrings(spark):
    t = turns(spark, ("user", "Deploy the parser", 0), ("assistant", "done", 0), ("user", "other", 0))
    docs, nodes = transcript.documents(t), transcript.nodes(t)
    got = [(r["node_id"], r["score"], r["reason"]) for r in transcript.query(docs, nodes, "pars parser pars x").collect()]
    assert got == [("000001", 30, "matched query terms: pars, parser, pars")]
    assert [r["node_id"] for r in transcript.query(docs, nodes, "turn").collect()] == ["000001", "000002"]
    assert transcript.query(docs, nodes, "x !").collect() == []


def test_content(spark):
    t = turns(spark, ("user", "a\n\nb", 0), ("assistant", "c", 0))
    docs, nodes = transcript.documents(t), transcript.nodes(t)
    assert transcript.content(docs, nodes, "d", "000001") == "User: a\n\nb\n\nAssistant: c\n"
    assert transcript.content(docs, nodes, "d", "turns:1-9") == "b\n\nAssistant: c\n"
    for bad in ("nope", "3-1"):
        with pytest.raises(ValueError, match="locator"):
            transcript.content(docs, nodes, "d", bad)
    with pytest.raises(ValueError, match="after end"):
        transcript.content(docs, nodes, "d", "9-9")


def test_build(spark, tmp_path):
    root = tmp_path / "s"
    root.mkdir()
    for name in ("one", "two", "empty"):
        rows = [{"type": "user", "message": {"content": f"ask {name}"}}, {"type": "assistant", "message": {"content": [{"type": "text", "text": "ok"}]}}] if name != "empty" else []
        (root / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    out = str(tmp_path / "out")
    got = transcript_index.build(spark, [files.Rule(str(root), "typed", "session", ".jsonl")], out)
    assert got == {"files": 3, "sessions": 2, "nodes": 2}
    assert [r["doc_id"] for r in transcript_index.query(spark, out, "ask two").collect()] == ["two", "one"]
    assert transcript_index.content(spark, out, "one.jsonl", "000001") == "User: ask one\n\nAssistant: ok\n"
    transcript_index.write_json(spark, out, str(tmp_path / "json"))
    docs, nodes = transcript_index.read_json(spark, str(tmp_path / "json"))
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, transcript_index.load(spark, out)[0].collect()))
    assert nodes.count() == 2 and transcript_index.read_json(spark, str(tmp_path / "none"))[0].count() == 0


def test_selectors(spark, tmp_path):
    root = tmp_path / "sessions"
    root.mkdir()
    line = '{"type": "user", "message": {"content": "hello"}}\n'
    for name in ("a b.c.jsonl", "plain.jsonl"):
        (root / name).write_text(line)
    out = str(tmp_path / "index")
    transcript_index.build(spark, [files.Rule(str(root), "typed", "session", ".jsonl")], out)
    for selector in ("a_b_c", "a_b_c.json", "a b.c", "dir/a_b_c.json", "plain", "plain.jsonl", "x/plain.jsonl.zst"):
        assert transcript_index.content(spark, out, selector, "000001") == "User: hello\n", selector
    with pytest.raises(ValueError):
        transcript_index.content(spark, out, "other", "000001")


def test_failed_build_keeps_the_index(spark, tmp_path, monkeypatch):
    root = tmp_path / "sessions"
    root.mkdir()
    (root / "one.jsonl").write_text('{"type": "user", "message": {"content": "hello"}}\n')
    out, rules = str(tmp_path / "index"), [files.Rule(str(root), "typed", "session", ".jsonl")]
    transcript_index.build(spark, rules, out)
    (root / "two.jsonl").write_text('{"type": "user", "message": {"content": "again"}}\n')
    with monkeypatch.context() as m:
        m.setattr(transcript_index.transcript, "nodes", lambda rows: rows.withColumn("x", F.raise_error(F.lit("no"))))
        with pytest.raises(Exception):
            transcript_index.build(spark, rules, out)
    docs, nodes = transcript_index.load(spark, out)
    assert docs.count() == 1 and nodes.count() == 1
    assert transcript_index.build(spark, rules, out) == {"files": 2, "sessions": 2, "nodes": 2}
    assert sorted(p.name for p in tmp_path.iterdir() if "stage" in p.name or "backup" in p.name) == []
