import os

import pytest

from brindle.functions import text as T
from brindle.operators import kb
from brindle.plans import kb_index


def md(spark, **files):
    rows = [(p, k + 1, line) for p, text in files.items() for k, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "path string, line_no int, line string")


def nodes(spark, *rows):
    return spark.createDataFrame([(p, a, a + 1, h, b) for p, a, h, b in rows], "path string, line_start int, line_end int, heading_path string, normalized_body string")


def test_sections(spark):
    text = "\n\nintro\n# A\nx\n### B\n```\n# no\n~~~\n### C #\n#no space\n####### seven\n## D\n"
    got = [(r["line_start"], r["line_end"], r["heading_path"], r["text"]) for r in kb.sections(md(spark, **{"n/note.md": text.rstrip("\n")})).orderBy("line_start").collect()]
    assert got[0] == (3, 3, "note", "intro")
    assert [g[2] for g in got] == ["note", "A", "A > B", "A > B > C", "no space", "no space > D"]
    assert got[2][3] == "### B\n```\n# no\n~~~"
    assert got[-1][:2] == (13, 13)


def test_heading_stack_is_cut_by_length(spark):
    got = [r["heading_path"] for r in kb.sections(md(spark, **{"f.md": "# A\n### B\n### C\n## D"})).orderBy("line_start").collect()]
    assert got == ["A", "A > B", "A > B > C", "A > D"]


def test_unclosed_fence_runs_to_the_end(spark):
    assert [r["heading_path"] for r in kb.sections(md(spark, **{"f.md": "```\n# no\n# no"})).collect()] == ["f"]


def test_body_drops_the_heading(spark):
    got = {r["heading_path"]: r["normalized_body"] for r in kb.nodes(md(spark, **{"f.md": "# A\n one\n\ttwo  three\n# B"})).collect()}
    assert got == {"A": "one two three", "B": ""}


def test_score_weights_and_coverage(spark):
    rows = nodes(spark, ("a.md", 1, "alpha", "x"), ("alpha.md", 1, "h", "x"), ("c.md", 1, "h", "alpha"), ("d.md", 1, "h", "none"))
    got = {r["path"]: r["score"] for r in kb.scored(rows, "alpha").collect()}
    assert got == {"a.md": T.stride(1) + 60000, "alpha.md": T.stride(1) + 40000, "c.md": T.stride(1) + 10000 + 1000}
    both = nodes(spark, ("one.md", 1, "alpha alpha alpha", "alpha alpha"), ("two.md", 1, "h", "alpha then beta"))
    assert [r["path"] for r in kb.search(both, "alpha beta").collect()] == ["two.md"]


def test_phrase_length_and_cap(spark):
    rows = nodes(spark, ("a.md", 1, "h", "beta alpha x"), ("b.md", 1, "h", "alpha beta x"), ("c.md", 1, "h", "alpha beta " + "w " * 400))
    got = [r["path"] for r in kb.search(rows, "alpha beta").collect()]
    assert got == ["b.md", "a.md", "c.md"]
    few, many = (kb.scored(nodes(spark, ("a.md", 1, "h", "t " * n + "z " * (100 - n))), "t").first()["score"] for n in (3, 90))
    assert few == many


def test_archive_ties_and_one_section_for_each_path(spark):
    rows = nodes(spark, ("archive/a.md", 1, "t t", "t"), ("b.md", 4, "t", "x"), ("b.md", 10, "t", "x"), ("a.md", 1, "h", "t"))
    got = [(r["path"], r["node_id"]) for r in kb.search(rows, "t").collect()]
    assert got == [("b.md", "10-11"), ("a.md", "1-2")]
    assert [r["path"] for r in kb.search(nodes(spark, ("x/Archive-1/a.md", 1, "t", "")), "t").collect()] == ["x/Archive-1/a.md"]


def test_unicode_tokens(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(T.tokens(F.lit("Résumé-家庭网络 x² 3")).alias("t")).first()["t"]
    assert got == ["résumé", "家庭网络", "x²", "3"] == T.python_tokens("Résumé-家庭网络 x² 3")
    assert kb.search(nodes(spark, ("a.md", 1, "h", "t")), "?!").collect() == []


def test_tsv(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a\\t\tb\n\r\\",)], "x string")
    assert df.select(T.unescape_tsv(T.escape_tsv(F.col("x"))).alias("y")).first()["y"] == "a\\t\tb\n\r\\"
    with pytest.raises(Exception, match="invalid TSV escape"):
        spark.createDataFrame([("a\\q",)], "x string").select(T.unescape_tsv(F.col("x"))).collect()


def test_index_life(spark, tmp_path):
    root, index = tmp_path / "kb", tmp_path / "ix"
    root.mkdir()
    (root / "a b+c.md").write_text("# Apple\nred fruit\n")
    (root / "empty.md").write_text("")
    assert kb_index.build(spark, str(root), str(index)) == kb_index.Summary(2, 1)
    assert kb_index.fresh(spark, str(root), str(index))
    (root / "new.md").write_text("# Pear\ngreen fruit\n")
    with pytest.raises(RuntimeError, match="stale"):
        kb_index.search(spark, str(root), str(index), "fruit", rebuild=False)
    got = kb_index.search(spark, str(root), str(index), "green fruit").collect()
    assert [r["path"] for r in got] == ["new.md"]
    rows, warning = kb_index.context(spark, str(root), str(index), "apple")
    assert (rows[0]["path"], rows[0]["text"], warning) == ("a b+c.md", "# Apple\nred fruit", None)
    (root / "bad.md").write_bytes(b"# \xff\n")
    rows, warning = kb_index.context(spark, str(root), str(index), "apple")
    assert rows and warning.startswith("KB PageIndex rebuild failed; using stale index")
    assert sorted(n for n in os.listdir(tmp_path) if "staging" in n or "backup" in n) == []
    with pytest.raises(ValueError):
        kb_index.build(spark, str(root), str(root / "inside"))


def test_white_space_at_the_ends_and_blank_lines(spark):
    from pyspark.sql import functions as F

    spaces = ["", " ", "x", " x y \n", "a ", "x\n \ny", "\r\n", "　　家 庭　", "é\t"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(spaces)], "k int, x string")
    assert [r["a"] for r in df.orderBy("k").select(T.trim_long(F.col("x")).alias("a")).collect()] == [x.strip() for x in spaces]
    assert [r["a"] for r in df.orderBy("k").select(T.collapse(F.col("x")).alias("a")).collect()] == [" ".join(x.split()) for x in spaces]
    rows = kb.sections(md(spark, **{"a.md": "\n \n", "b.md": " \n  one \n\n# A\n\n", "c.md": "# A\n \n# B\n\n"}))
    assert sorted((r["path"], r["line_start"], r["line_end"], r["text"]) for r in rows.collect()) == [("b.md", 2, 3, "one"), ("b.md", 4, 6, "# A"), ("c.md", 1, 2, "# A"), ("c.md", 3, 5, "# B")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 2
