"""The history store over several roots, fresh runs, headers and broken files; texts of any script."""

import json

import pytest
from pyspark.sql import functions as F

from brindle import cli, config, embed
from brindle.functions import text as T
from brindle.plans import history_index
from brindle.sources import files, tsv

MAKE = lambda: embed.HashingEmbedder(16)


def prompt(text):
    return json.dumps({"type": "user", "message": {"content": text}}) + "\n"


def put(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(lines))
    return str(path)


def found(*roots, header=False):
    return files.discover([files.Rule(str(r), "typed", "session", s, header) for r in roots for s in (".jsonl", ".jsonl.zst")])


def test_fresh_keeps_other_roots(spark, tmp_path):
    store = str(tmp_path / "store")
    put(tmp_path / "one" / "a.jsonl", prompt("about bread"), prompt("and butter"))
    put(tmp_path / "two" / "b.jsonl", prompt("about parsers"))
    assert history_index.index(spark, found(tmp_path / "one"), store, MAKE) == 1
    assert history_index.index(spark, found(tmp_path / "two"), store, MAKE) == 1
    assert history_index.index(spark, found(tmp_path / "one"), store, MAKE, fresh=True) == 1
    rows = history_index.points(spark, store).collect()
    assert sorted(r["text"] for r in rows) == ["User: about bread\nUser: and butter", "User: about parsers"]
    assert len({r["point_id"] for r in rows}) == 2
    assert not [p for p in (tmp_path / "store").iterdir() if p.name.startswith(".stage")]
    with pytest.raises(ValueError):
        history_index.index(spark, [], "s3://bucket/store", MAKE)


def test_the_first_full_path_wins(spark, tmp_path):
    put(tmp_path / "a" / "root2" / "x.jsonl", prompt("the same words"))
    put(tmp_path / "z" / "root1" / "a.jsonl", prompt("the same words"))
    roots = (tmp_path / "a" / "root2", tmp_path / "z" / "root1")
    store = str(tmp_path / "store")
    history_index.index(spark, found(*roots), store, MAKE, bases={str(r): str(r) for r in roots})
    assert [r["path"] for r in history_index.points(spark, store).collect()] == ["x.jsonl"]


def test_headers_and_broken_files(spark, tmp_path):
    head = json.dumps({"type": "session"}) + "\n"
    message = json.dumps({"type": "message", "message": {"role": "user", "content": [{"type": "text", "text": "kept words"}]}}) + "\n"
    put(tmp_path / "r" / "good.jsonl", head, message)
    put(tmp_path / "r" / "artefact.jsonl", message.replace("kept", "other"))
    (tmp_path / "r" / "broken.jsonl.zst").write_bytes(b"\x28\xb5\x2f\xfd not a frame")
    store = str(tmp_path / "store")
    history_index.index(spark, found(tmp_path / "r", header=True), store, MAKE)
    assert [r["text"] for r in history_index.points(spark, store).collect()] == ["User: kept words"]


def test_tokens_agree_on_both_sides(spark):
    texts = ["हिन्दी में खोज", "Straße ÉTÉ naïve", "日本語 テスト", "a_b c-d 12", "ไทย ภาษา"]
    for text, got in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.tokens(F.col("t"))).collect():
        assert T.python_tokens(text) == list(got)


def test_tsv_keeps_every_character(spark):
    texts = ["a\0b", "\\", "\\\\t", "tab\tnew\nline\r\\n", "\\\0\\", "", "é x"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "n long, t string")
    fields = (("n", "long"), ("t", "string"))
    back = tsv.parse(tsv.render(df, fields).withColumn("row", F.lit(1)), fields)
    assert sorted(map(tuple, back.collect())) == list(enumerate(texts))


def test_headings_with_line_separators(spark):
    lines = ["# a b", "## c\rd", "　### e\u0085f", "####### seven", "# "]
    rows = spark.createDataFrame([(t,) for t in lines], "t string").select(T.heading_level(F.col("t")), T.is_heading(F.col("t"))).collect()
    assert [tuple(r) for r in rows][:3] == [(1, True), (2, True), (3, True)] and not any(r[1] for r in rows[3:])


def test_the_command_line_reads_its_profile(spark, tmp_path, capsys):
    store, own = str(tmp_path / "store"), tmp_path / "config.toml"
    put(tmp_path / "r" / "a.jsonl", prompt("about bread"))
    own.write_text('[embedding]\nbackend = "hashing"\nmodel = "m"\nvector_size = 32\ncollection = "c"\n')
    cli.main(["--store", store, "--config", str(own), "index", f"{tmp_path / 'r'}:typed:session"], spark)
    assert len(history_index.points(spark, store).first()["embedding"]) == 32
    cli.main(["--store", store, "--config", str(own), "search", "bread", "--json"], spark)
    assert "about bread" in capsys.readouterr().out
    own.write_text(own.read_text() + "[search]\nenabled = false\n")
    cli.main(["--store", store, "--config", str(own), "search", "bread", "--json"], spark)
    assert "about bread" not in capsys.readouterr().out
    own.write_text(own.read_text().replace('"hashing"', '"hosted"'))
    with pytest.raises(SystemExit, match="none.toml"):
        cli.main(["--store", store, "--config", str(own), "--key-file", str(tmp_path / "none.toml"), "search", "bread"], spark)
    assert config.load(str(tmp_path / "none.toml")) == config.Config()


def test_messages_keep_the_order_of_their_lines(spark, tmp_path):
    """Files are read whole: lines have their numbers, and a stream is not sorted by its texts."""
    store = str(tmp_path / "store")
    put(tmp_path / "r" / "a.jsonl", prompt("zeta first"), "not json\n", prompt("alpha then"))
    history_index.index(spark, found(tmp_path / "r"), store, MAKE)
    assert [r["text"] for r in history_index.points(spark, store).collect()] == ["User: zeta first\nUser: alpha then"]


def test_every_chunk_is_searched(spark):
    from brindle import views
    from brindle.operators import history

    d = "/root/testdata/sf0.1"
    rows = views.store(spark, d)
    assert rows.count() == history.first_of_each(views.chunk_rows(spark, d)).count()
    assert rows.where("type = 'prompt'").count() > 0 and rows.where("embedding IS NULL").count() == 0


def listing(store):
    return {str(p.relative_to(store)): p.stat().st_mtime_ns for p in store.glob("points/**/*.parquet")}


def test_a_run_touches_its_buckets_only(spark, tmp_path):
    """Files of other buckets are neither read nor written; a reader has a run whole or not at all."""
    store = tmp_path / "store"
    for k in range(40):
        put(tmp_path / "old" / f"{k}.jsonl", prompt(f"old words {k}"))
    assert history_index.index(spark, found(tmp_path / "old"), str(store), MAKE) == 40
    before, state = listing(store), history_index.pointers(str(store))
    put(tmp_path / "new" / "a.jsonl", prompt("quite new words"))
    assert history_index.index(spark, found(tmp_path / "new"), str(store), MAKE) == 1
    after = history_index.pointers(str(store))
    changed = {b for b in after["buckets"] if after["buckets"][b] != state["buckets"].get(b)}
    assert len(changed) == 1 and {k: v for k, v in listing(store).items() if k in before} == before
    added = set(listing(store)) - set(before)
    assert len(added) == 1 and f"bucket={changed.copy().pop()}" in added.pop()
    own = history_index.points(spark, str(store), changed)
    read = {p.split("bucket=")[1][:2] for p in own.inputFiles()}
    assert read == changed and own.count() >= 1
    assert "bucket" in own._jdf.queryExecution().executedPlan().toString()
    assert history_index.points(spark, str(store)).count() == 41
    # Known rows are found again in their buckets.
    assert history_index.index(spark, found(tmp_path / "old", tmp_path / "new"), str(store), MAKE) == 0
    assert history_index.index(spark, found(tmp_path / "old"), str(store), MAKE, fresh=True) == 40
    assert history_index.points(spark, str(store)).count() == 41
    assert len({r["point_id"] for r in history_index.points(spark, str(store)).collect()}) == 41


def test_old_generations_go_and_buckets_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history_index, "GENERATIONS", 2)
    monkeypatch.setattr(history_index, "bucket_of", lambda *_: F.lit("a"))
    store = tmp_path / "store"
    for k in range(5):
        put(tmp_path / f"r{k}" / "a.jsonl", prompt(f"words {k}"))
        assert history_index.index(spark, found(tmp_path / f"r{k}"), str(store), MAKE) == 1
    gens = history_index.pointers(str(store))["buckets"]["a"]
    assert len(gens) <= 2 and history_index.points(spark, str(store)).count() == 5
    history_index.index(spark, [], str(store), MAKE)
    assert {int(p.name[4:]) for p in (store / "points").iterdir()} == set(gens)


def test_a_failed_run_changes_nothing(spark, tmp_path):
    store = tmp_path / "store"
    put(tmp_path / "r" / "a.jsonl", prompt("first words"))
    history_index.index(spark, found(tmp_path / "r"), str(store), MAKE)
    before = listing(store), history_index.pointers(str(store))

    class Fails(embed.HashingEmbedder):
        def embed(self, texts):
            raise RuntimeError("no service")

    put(tmp_path / "r" / "b.jsonl", prompt("second words"))
    with pytest.raises(Exception, match="no service"):
        history_index.index(spark, found(tmp_path / "r"), str(store), lambda: Fails(16))
    assert (listing(store), history_index.pointers(str(store))) == before
    assert [p.name for p in store.iterdir() if p.name.startswith(".stage")] == []


def test_another_vector_size_raises(spark, tmp_path):
    store = str(tmp_path / "store")
    put(tmp_path / "r" / "a.jsonl", prompt("some words"))
    history_index.index(spark, found(tmp_path / "r"), store, MAKE)
    for run in (history_index.search, history_index.paired):
        with pytest.raises(ValueError, match="16 dimensions, the embedder 8"):
            run(spark, store, "words", embed.HashingEmbedder(8))
