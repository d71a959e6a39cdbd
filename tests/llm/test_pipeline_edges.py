"""The pipeline over nulls in every column, empty texts, repeated rows and empty tables."""

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, docs, labels):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_nulls_and_repeats(spark, tmp_path):
    words = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    docs = [(k, words(k), "en", f"s{k % 3}", 100) for k in range(12)]
    docs += [(0, words(0), "en", "s0", 100), (20, words(1), "en", "s1", 100), (21, None, "en", "s1", None), (22, "", None, None, 0), (None, words(30), "fr", "s2", 5), (23, words(31), None, None, 5), (24, " \n ", "en", "s0", 3)]
    out = corpus_pipeline.run(spark, tables(spark, tmp_path, docs, [(k, 1, 0) for k in range(8)] + [(None, None, None), (9, None, 1)])).collect()
    assert all(r["decoded_sha256"] for r in out)
    kept = {r["doc_id"] for r in out}
    assert len(kept & set(range(12))) >= 11 and not {1, 20} <= kept


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "a", [], [])).collect() == []
    docs = [(k, f"some words {k} here", "en", "s", 1) for k in range(3)]
    out = corpus_pipeline.run(spark, tables(spark, tmp_path / "b", docs, [])).collect()
    assert {r["doc_id"] for r in out} <= {0, 1, 2} and out
