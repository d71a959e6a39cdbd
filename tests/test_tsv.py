import pytest

from brindle.sources import tsv


def test_round_trip_and_errors(spark, tmp_path):
    rows = [("a\tb.md", 1, 3, "A > B", "x\\y"), ("c.md", 4, 4, "é", "")]
    df = spark.createDataFrame(rows, "path string, line_start long, line_end long, heading_path string, normalized_body string")
    tsv.write(df, str(tmp_path / "nodes"))
    assert sorted(map(tuple, tsv.read(spark, str(tmp_path / "nodes")).collect())) == sorted(rows)
    for bad, said in (("a\t1\t2\th", "field count in row 1"), ("a\tx\t2\th\tb", "line_start in row 1"), ("a\t3\t2\th\tb", "line range in row 1"), ("a\\q\t1\t2\th\tb", "escape")):
        (tmp_path / "bad.tsv").write_text(bad + "\n")
        with pytest.raises(Exception, match=said):
            tsv.read(spark, str(tmp_path / "bad.tsv")).collect()
    m = spark.createDataFrame([("p", 5, 6)], "path string, mtime_ns long, size long")
    tsv.write(m, str(tmp_path / "m"), tsv.MANIFEST)
    assert tsv.read(spark, str(tmp_path / "m"), tsv.MANIFEST).collect() == [("p", 5, 6)]


@pytest.mark.parametrize("step", [7, 50, 1 << 20])
def test_rows_are_numbered_over_ranges_and_parts(spark, tmp_path, step):
    """Errors name the row of the whole index, whatever part and range it is in."""
    folder = tmp_path / "parts"
    folder.mkdir()
    made = [f"p{k}\t{k + 1}\t{k + 2}\th\tb" for k in range(40)]
    for n, cut in enumerate((made[:13], [], made[13:14], made[14:])):
        (folder / f"part-{n:05d}.txt").write_text("".join(x + "\n" for x in cut))
    (folder / "_SUCCESS").write_text("")
    assert sorted(r["line_start"] for r in tsv.read(spark, str(folder), range_bytes=step).collect()) == list(range(1, 41))
    for bad in (0, 13, 14, 39):
        rows = list(made)
        rows[bad] = "p\tx\t2\th\tb"
        for n, cut in enumerate((rows[:13], [], rows[13:14], rows[14:])):
            (folder / f"part-{n:05d}.txt").write_text("".join(x + "\n" for x in cut))
        with pytest.raises(Exception, match=f"line_start in row {bad + 1}\\b"):
            tsv.read(spark, str(folder), range_bytes=step).collect()


def test_parts_join_to_a_sorted_file(spark, tmp_path):
    df = spark.createDataFrame([(f"p{k % 7}", k + 1, k + 2, "h", "b") for k in range(60)], "path string, line_start long, line_end long, heading_path string, normalized_body string")
    tsv.write(df.repartition(5), str(tmp_path / "nodes"))
    tsv.join_parts(str(tmp_path / "nodes"), str(tmp_path / "nodes.tsv"))
    want = sorted(((f"p{k % 7}", k + 1, k + 2, "h", "b") for k in range(60)))
    assert [tuple(x.split("\t")) for x in (tmp_path / "nodes.tsv").read_text().splitlines()] == [tuple(map(str, r)) for r in want]
    assert sorted(map(tuple, tsv.read(spark, str(tmp_path / "nodes.tsv")).collect())) == want
