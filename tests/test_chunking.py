import hashlib

from hypothesis import given, settings, strategies as st

from brindle.functions.chunking import OVERLAP, SIZE, chunks, cut_text, point_id, text_hash


def test_short_and_blank():
    assert cut_text("  \n ") == []
    assert cut_text("  hello\n") == ["hello"]
    assert cut_text("x" * SIZE) == ["x" * SIZE]


def test_overlap_and_tail_echo():
    text = "".join(chr(97 + k % 26) for k in range(3000))
    got = cut_text(text)
    assert got[0] == text[:SIZE]
    assert got[1] == text[SIZE - OVERLAP : 2 * SIZE - OVERLAP]
    assert got[-1] == text[-OVERLAP:]  # one more piece repeats the end


def test_cuts_after_the_last_newline_that_is_late_enough():
    late = "a" * 1000 + "\n" + "b" * 1500
    assert cut_text(late)[0] == "a" * 1000
    early = "a" * 300 + "\n" + "b" * 2000
    assert cut_text(early)[0] == early[:SIZE]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aé\n 家", max_size=5000))
def test_every_word_is_in_some_piece(text):
    pieces = cut_text(text)
    assert all(p == p.strip() and 0 < len(p) <= SIZE for p in pieces)
    if len(text.strip()) <= SIZE:
        assert pieces == ([text.strip()] if text.strip() else [])


def test_identity(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None)], "id int, text string")
    rows = chunks(df).collect()
    assert [(r["id"], r["chunk_idx"], r["chunk"], r["hash"]) for r in rows] == [(1, 0, "Hello world", "64ec88ca00b268e5")]
    from pyspark.sql import functions as F

    got = spark.range(1).select(point_id(F.lit("prompt:session:ab")).alias("p"), text_hash(F.lit("x")).alias("h")).first()
    h = hashlib.sha256(b"prompt:session:ab").hexdigest()
    assert got["p"] == f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"


def test_batches_are_bounded_however_long_the_texts_are():
    import pyarrow as pa

    from brindle.functions.chunking import BATCH, ROWS, cut_batches

    texts = ["x y" * BATCH, None, "", "short", *["ab"] * (ROWS + 10), "line\n" * 1000]
    source = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts, "tag": ["t"] * len(texts)})
    made = cut_batches(iter([source]), "text")
    first = next(made)  # before the rest is cut
    assert first.schema.names == ["id", "tag", "chunk_idx", "chunk"] and set(first["id"].to_pylist()) == {0}
    every = [first, *made]
    assert all(b.num_rows <= ROWS and sum(map(len, b["chunk"].to_pylist())) < BATCH + SIZE for b in every)
    got = [(r["id"], r["chunk_idx"], r["chunk"]) for b in every for r in b.to_pylist()]
    assert got == [(i, k, piece) for i, t in enumerate(texts) for k, piece in enumerate(cut_text(t or ""))]


def test_a_table_of_texts_alone(spark):
    assert [tuple(r) for r in chunks(spark.createDataFrame([("a",), (None,)], "text string")).select("chunk_idx", "chunk").collect()] == [(0, "a")]
