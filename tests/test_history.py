import io
import json

import pytest
import zstandard

from brindle import cli, config, embed
from brindle.operators import present, vector
from brindle.plans import enrich, history_index
from brindle.sources import files, logs
from brindle.streaming import incremental

MAKE = lambda: embed.HashingEmbedder(32)


def write(path, *pairs):
    path.parent.mkdir(parents=True, exist_ok=True)
    rows = [json.dumps({"type": "user", "message": {"content": q}}) + "\n" + json.dumps({"type": "assistant", "message": {"content": [{"type": "text", "text": a}]}}) + "\n" for q, a in pairs]
    data = "".join(rows).encode()
    path.write_bytes(zstandard.compress(data) if path.suffix == ".zst" else data)


def test_index_search_and_increment(spark, tmp_path):
    root, store = tmp_path / "p", str(tmp_path / "store")
    write(root / "a" / "one.jsonl", ("how to bake bread", "use yeast and flour"))
    write(root / "b" / "two.jsonl.zst", ("fix the parser", "the token was wrong"))
    found = files.discover([files.Rule(str(root), "typed", "session", ".jsonl"), files.Rule(str(root), "typed", "archive", ".jsonl.zst")])
    bases = {"p": str(root)}
    assert history_index.index(spark, found, store, MAKE, bases=bases) == 4
    assert history_index.index(spark, found, store, MAKE, bases=bases) == 0
    write(root / "a" / "zero.jsonl", ("how to bake bread", "new answer"))  # the prompt is known
    assert history_index.index_file(spark, str(root / "a" / "zero.jsonl"), store, MAKE) == 1
    assert history_index.stats(spark, store) == 5
    top = history_index.search(spark, store, "bake bread", MAKE(), 2).collect()
    assert (top[0]["text"], top[0]["path"], top[0]["session_id"]) == ("User: how to bake bread", "a/one.jsonl", "one")
    assert [r["source"] for r in history_index.search(spark, store, "parser", MAKE(), sources=["archive"], kind="answer").collect()] == ["archive"]
    # A filter applies before the limit.
    assert [r["session_id"] for r in history_index.search(spark, store, "bake bread", MAKE(), 1, session="tw").collect()] == ["two"]
    assert history_index.search(spark, store, "x", MAKE(), session="zzz").collect() == []
    assert history_index.search(spark, store, "x", MAKE(), enabled=False).collect() == []
    with pytest.raises(ValueError):
        history_index.search(spark, store, "x", MAKE(), session=" ")
    with pytest.raises(ValueError, match="dimensions"):
        history_index.index(spark, found, store, lambda: embed.HashingEmbedder(16))
    kb_root = tmp_path / "kb"
    kb_root.mkdir()
    (kb_root / "n.md").write_text("# Bread\nbake it\n")
    out = json.loads(enrich.run(spark, "bake bread", store, MAKE(), str(kb_root), str(tmp_path / "ix")))["hookSpecificOutput"]["additionalContext"]
    assert out.startswith(present.SESSION_TITLE) and "### prompts" in out and present.KB_TITLE in out and "n.md > Bread [1-2]: # Bread bake it" in out
    assert enrich.run(spark, "", store, MAKE(), str(kb_root), str(tmp_path / "ix")) == "{}"


def test_stream_equals_batch(spark, tmp_path):
    root = tmp_path / "p"
    write(root / "one.jsonl", ("q1", "a1"))
    run = lambda: incremental.watch(spark, str(root), "typed", str(tmp_path / "s"), MAKE, str(tmp_path / "c")).awaitTermination(120)
    run()
    write(root / "two.jsonl", ("q1", "a2"))
    run()
    got = sorted(r["text"] for r in history_index.points(spark, str(tmp_path / "s")).collect())
    assert got == ["Assistant: a1", "Assistant: a2", "User: q1"]


def test_cosine_ties_and_paired(spark):
    rows = [("b", "prompt", "session", "s1", [1.0, 0.0]), ("a", "prompt", "session", "s2", [2.0, 0.0]), ("c", "answer", "archive", "s3", [0.0, 1.0]), ("d", "answer", "session", "s4", [0.0, 0.0])]
    store = spark.createDataFrame(rows, "point_id string, type string, source string, session_id string, embedding array<float>")
    assert [(r["point_id"], round(r["score"], 6)) for r in vector.search(store, [1.0, 0.0]).collect()] == [("a", 1.0), ("b", 1.0), ("c", 0.0), ("d", 0.0)]
    got = [(r["type"], r["point_id"]) for r in vector.paired(store, [0.0, 1.0], 1).orderBy("type").collect()]
    assert got == [("answer", "c"), ("prompt", "a")]


def test_hook_and_listings():
    assert present.hook_output("") == "{}"
    assert enrich.read_prompt(None, io.StringIO('{"prompt": 5}')) == ""
    assert enrich.read_prompt("arg", io.StringIO("not json")) == "arg"
    with pytest.raises(ValueError):
        enrich.read_prompt(None, io.StringIO("nope"))
    assert present.kb_listing([]) == "(no KB notes found)" and present.transcript_listing([]) == "(no transcript notes found)"
    row = {"source": "session", "path": "p", "score": 0.5, "text": "a\nb" + "é" * 300}
    assert present.results_listing([row]).startswith("1. [session] p (score: 0.500)\n   a b") and present.results_listing([row]).rstrip().endswith("...")


def test_discovery_order_and_archives(tmp_path):
    for name in ("a-b/x.jsonl", "a/b.jsonl", "c.md"):
        write(tmp_path / name)
    got = [f.path[len(str(tmp_path)) + 1 :] for f in files.discover([files.Rule(str(tmp_path), "typed", "session", ".jsonl")])]
    assert got == ["a/b.jsonl", "a-b/x.jsonl"]
    assert files.discover([files.Rule(str(tmp_path / "none"), "typed", "session", ".jsonl")]) == []
    assert files.is_archive_session("/x/archived_sessions/a.jsonl") and files.is_archive_session("/h/.claude/archive/a") and not files.is_archive_session("/h/archive/a")


def test_config_precedence():
    own = config.parse('[search]\nenabled = false\n[embedding]\nbackend = "local"\nmodel = "m"\nvector_size = 8\ncollection = "c"\n')
    assert not own.search_enabled and config.resolve(own, {}.get).vector_size == 8
    assert config.resolve(own, {"BRINDLE_EMBEDDING_VECTOR_SIZE": "16"}.get).vector_size == 16
    assert config.resolve(config.parse("not toml ["), {}.get) == config.Embedding()
    bad = config.parse('[embedding]\nbackend = "local"\n')
    with pytest.raises(ValueError):
        config.resolve(bad, {}.get)
    with pytest.raises(ValueError):
        config.resolve(own, {"BRINDLE_EMBEDDING_MODEL": " "}.get)
    assert config.Embedding(query_instruction="find").format_query("q") == "Instruct: find\nQuery:q"


def test_remote_rules():
    assert embed.in_order([(1, [2.0]), (0, [1.0])], 2, 1) == [[1.0], [2.0]]
    for bad in ([(0, [1.0])], [(0, [1.0]), (0, [1.0])], [(0, [1.0]), (1, [1.0, 2.0])]):
        with pytest.raises(ValueError):
            embed.in_order(bad, 2, 1)
    waits, states = [], iter([(429, {"Retry-After": "2"}, ""), (503, {}, ""), (200, {}, "ok")])
    assert embed.with_retry(lambda: next(states), waits.append) == "ok" and waits[0] == 2 and 0.5 <= waits[1] <= 0.6
    with pytest.raises(RuntimeError):
        embed.with_retry(lambda: (400, {}, "bad"), waits.append)
    assert embed.retry_after("Wed, 21 Oct 2015 07:28:00 GMT") is None


def test_logs(tmp_path):
    assert "[c] (p)\nx\n" in open(logs.daily(str(tmp_path), "x", "c", "p")).read()
    assert logs.category(str(tmp_path / "none"), "x") is None
    assert logs.category(str(tmp_path), "x").endswith("memory/uncategorized.md")
    assert logs.project(str(tmp_path), "n", "y").endswith("projects/n.md")


def test_cli(spark, tmp_path, capsys):
    write(tmp_path / "p" / "one.jsonl", ("bake bread", "ok"))
    store = ["--store", str(tmp_path / "s")]
    cli.main([*store, "index", f"{tmp_path}/p:typed:session"], spark)
    cli.main([*store, "search", "bake bread", "--json", "--limit", "1"], spark)
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "indexed 2 new chunks"
    assert list(json.loads(out[1])) == ["type", "text", "source", "path", "session_id", "score"]
    with pytest.raises(SystemExit):
        cli.main(["search", "q", "--session", " "], spark)
