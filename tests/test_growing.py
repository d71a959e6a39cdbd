"""Transcripts that grow, in several batches, against a batch run over their last state."""

import json
import random

import pytest
import zstandard

from brindle.functions.chunking import cut_text
from brindle.plans import history_index
from brindle.sources import files
from brindle.streaming import growing, incremental
from tests.test_store import MAKE, prompt, put


def answer(text):
    return json.dumps({"type": "assistant", "message": {"content": [{"type": "text", "text": text}]}}) + "\n"


def test_windows_of_a_growing_text():
    """Chunks of any split into batches are those of the whole text."""
    r = random.Random(11)
    for _ in range(400):
        parts = ["".join(r.choice(["word ", "x" * r.randint(1, 400), "\n", "é ", " ", "\n\n"]) for _ in range(r.randint(0, 14))) for _ in range(r.randint(1, 5))]
        parts = ["User: " + p for p in parts]
        tail, done, now, moved = "", [], [], False
        for p in parts:
            stay, tail, now, moved = incremental.advance(tail, p, moved)
            done += stay
        assert done + now == cut_text("\n".join(parts))


def lines_of(r, n):
    return [r.choice([prompt, answer])(" ".join(r.choice("alpha beta gamma delta".split()) + str(r.randint(0, 10**6)) for _ in range(r.randint(1, 120)))) for _ in range(n)]


def state(spark, store):
    return sorted((r["point_id"], r["text"], r["path"], r["session_id"], r["type"], r["source"]) for r in history_index.points(spark, store).collect())


def test_three_batches_leave_what_one_run_leaves(spark, tmp_path):
    r = random.Random(12)
    root, store, checkpoint = tmp_path / "r", str(tmp_path / "s"), str(tmp_path / "c")
    rules = [files.Rule(str(root), "typed", "session", s, True) for s in (".jsonl", ".jsonl.zst")]
    head = json.dumps({"type": "session"}) + "\n"
    own = {name: [head, *lines_of(r, 24)] for name in ("a.jsonl", "sub/b.jsonl")}
    zipped = [head, *lines_of(r, 12)]
    put(root / "artefact.jsonl", *lines_of(r, 5))
    run = lambda: incremental.watch(spark, rules, "", store, MAKE, checkpoint, bases={"r": str(root)}, most_files=2, most_bytes=4000)
    for step in range(3):
        for name, rows in own.items():
            half = rows[0 if step == 0 else step * 8 + 1 : (step + 1) * 8 + 1]
            text = "".join(half)
            with (put(root / name) and open(root / name, "w") if step == 0 else open(root / name, "a")) as f:
                f.write(text)
        if step != 1:
            with open(root / "z.jsonl.zst", "ab") as f:
                f.write(zstandard.compress("".join(zipped[:7] if step == 0 else zipped[7:]).encode()))
        if step == 1:  # a line whose end is not there yet
            with open(root / "a.jsonl", "a") as f:
                f.write(own["a.jsonl"][17][:20])
        run()
        if step == 1:
            own["a.jsonl"][17] = own["a.jsonl"][17][20:]
    with open(tmp_path / "c" / "growing.json") as f:
        taken = json.load(f)
    assert {p.split("/")[-1] for p in taken} == {"a.jsonl", "b.jsonl", "z.jsonl.zst"}
    once = str(tmp_path / "once")
    history_index.index(spark, files.discover(rules), once, MAKE, bases={"r": str(root)})
    got = state(spark, store)
    assert got == state(spark, once) and len(got) > 10
    run()
    assert state(spark, store) == got


def test_admission(tmp_path):
    for k in range(5):
        put(tmp_path / f"{k}.jsonl", "x" * 99 + "\n")
    put(tmp_path / "open.jsonl", "no newline")
    rules = [files.Rule(str(tmp_path), "typed", "session", ".jsonl")]
    for limits, want in (({"most_files": 2}, [2, 4, 5, 5]), ({"most_bytes": 250}, [2, 4, 5, 5]), ({"most_bytes": 1}, [1, 2, 3, 4])):
        reader = growing.Growing(growing.options(rules, str(tmp_path / "none"), **limits))
        assert [len(reader.latestOffset()) for _ in want] == want


def test_only_new_bytes_are_read(tmp_path):
    path = put(tmp_path / "a.jsonl", "one\n", "two\n")
    reader = growing.Growing(growing.options([files.Rule(str(tmp_path), "typed", "session", ".jsonl")], str(tmp_path / "p")))
    first = reader.latestOffset()
    reader.commit(first)
    with open(path, "a") as f:
        f.write("three\nfour")
    again = growing.Growing(growing.options([files.Rule(str(tmp_path), "typed", "session", ".jsonl")], str(tmp_path / "p")))
    second = again.latestOffset()
    (part,) = again.partitions(first, second)
    assert [x for b in again.read(part) for x in b.column(5).to_pylist()] == ["three"]
    assert again.partitions(second, second) == []
