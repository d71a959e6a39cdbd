"""The line source: ranges, numbers, compressed files, broken bytes, memory."""

import json
import os
import random
import subprocess
import sys

import pytest
import zstandard

from brindle.plans import history_index, transcript_index
from brindle.sources import files, lines
from tests.test_store import MAKE, prompt


def rows(df):
    return sorted((os.path.basename(r["path"]), r["line_no"], r["line"]) for r in df.collect())


def expected(name, text):
    parts = text.split("\n")
    parts = parts[:-1] if parts[-1] == "" else parts
    return [(name, k, p.removesuffix("\r")) for k, p in enumerate(parts, 1)]


@pytest.mark.parametrize("step", [1, 2, 7, 64, 1 << 20])
def test_ranges_number_lines(spark, tmp_path, step):
    r = random.Random(step)
    want, paths = [], []
    for name in ("a.jsonl", "b c+%41.jsonl", "d.jsonl.zst", "empty.jsonl", "one.jsonl"):
        text = "" if name.startswith("empty") else "x" if name == "one.jsonl" else "".join(r.choice(["", "é", "word", "\r", "\n", "\n\n", " ", "long " * 9]) for _ in range(30))
        data = text.encode()
        (tmp_path / name).write_bytes(zstandard.compress(data[:20]) + zstandard.compress(data[20:]) if name.endswith("zst") else data)
        want += expected(name, text)
        paths.append(str(tmp_path / name))
    df = lines.read(spark, paths, range_bytes=step)
    assert rows(df) == sorted(want)
    assert df.dtypes == [("path", "string"), ("line_no", "int"), ("line", "string")]


def test_partitions_follow_ranges(spark, tmp_path):
    (tmp_path / "a").write_text("0123456789\n" * 1000)
    for k in range(20):
        (tmp_path / f"s{k}").write_text("x\n")
    assert lines.read(spark, [str(tmp_path / "a")], range_bytes=1100).rdd.getNumPartitions() == 10
    assert lines.read(spark, [str(tmp_path / f"s{k}") for k in range(20)]).rdd.getNumPartitions() == 2


def broken(tmp_path):
    good = "".join(f"line {k}\n" for k in range(1, 6)).encode()
    (tmp_path / "utf.jsonl").write_bytes(good + b"bad \xff\nafter\n" + b"more\n" * 50)
    frame = zstandard.compress(good * 40_000)
    (tmp_path / "cut.jsonl.zst").write_bytes(frame[: len(frame) - 9])
    (tmp_path / "none.jsonl.zst").write_bytes(b"\x28\xb5\x2f\xfd not a frame")
    return [str(tmp_path / n) for n in ("utf.jsonl", "cut.jsonl.zst", "none.jsonl.zst")]


@pytest.mark.parametrize("step", [8, 1 << 20])
def test_broken_files(spark, tmp_path, step):
    utf, cut, none = broken(tmp_path)
    assert rows(lines.read(spark, [utf], "skip", step)) == [("utf.jsonl", k, f"line {k}") for k in range(1, 6)]
    assert rows(lines.read(spark, [none, str(tmp_path / "missing")], "skip", step)) == []
    got = rows(lines.read(spark, [cut], "skip", step))
    assert got == [("cut.jsonl.zst", k, f"line {(k - 1) % 5 + 1}") for k in range(1, len(got) + 1)] and len(got) < 200_000
    for path in (utf, cut, none):
        with pytest.raises(Exception, match="cannot read"):
            lines.read(spark, [path], "fail", step).collect()
    with pytest.raises(ValueError, match="cannot read"):
        lines.read(spark, [str(tmp_path / "missing")])


def test_policies_of_the_plans(spark, tmp_path):
    """An index run goes on; a transcript build and a single file raise."""
    root, out = tmp_path / "r", str(tmp_path / "out")
    root.mkdir()
    (root / "good.jsonl").write_text(prompt("about bread"))
    (root / "bad.jsonl.zst").write_bytes(b"\x28\xb5\x2f\xfd not a frame")
    rules = [files.Rule(str(root), "typed", "session", s) for s in (".jsonl", ".jsonl.zst")]
    assert history_index.index(spark, files.discover(rules), str(tmp_path / "store"), MAKE) == 1
    with pytest.raises(Exception, match="bad.jsonl.zst"):
        transcript_index.build(spark, rules, out)
    assert not os.path.exists(out)
    with pytest.raises(Exception, match="bad.jsonl.zst"):
        history_index.index_file(spark, str(root / "bad.jsonl.zst"), str(tmp_path / "store"), MAKE)


def test_memory_is_bounded(tmp_path):
    """A frame of 600 MB and a range of 300 MB pass through a process of few megabytes."""
    line = (json.dumps({"type": "user", "message": {"content": "word " * 200}}) + "\n").encode()
    with open(tmp_path / "big.jsonl.zst", "wb") as f, zstandard.ZstdCompressor().stream_writer(f) as w:
        for _ in range(600):
            w.write(line * (1_000_000 // len(line)))
    with open(tmp_path / "big.jsonl", "wb") as f:
        for _ in range(300):
            f.write(line * (1_000_000 // len(line)))
    code = f"""
import resource; from brindle.sources import lines
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
reader = lines.LineReader({{"ranges": "[]"}})
n = 0
for path in ({str(tmp_path / "big.jsonl.zst")!r}, {str(tmp_path / "big.jsonl")!r}):
    for batch in reader.lines(lines.Range(path, 0, 1 << 40)):
        n += batch.num_rows
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    n, grown = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(__file__))).stdout.split())
    assert n == 900 * (1_000_000 // len(line)) and grown < 100
