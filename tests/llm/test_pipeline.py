"""The pipeline against its stages by plain Python."""

import corpus_pipeline
from brindle.llm import bpe, near, pii, toxicity
from brindle.llm.mixing import plan

SF = "/root/testdata/sf0.001"


def test_run_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chain = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in docs.collect() if not toxicity.rejected(chain, chain.score(toxicity.words_of(r["text"])))]
    assert 0 < len(rows) < docs.count()
    sets, parent = {r["doc_id"]: near.shingles(r["text"]) for r in rows}, {r["doc_id"]: r["doc_id"] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and near.jaccard(sets[a], sets[b]) >= 0.8:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    rows = [r for r in rows if root(r["doc_id"]) == r["doc_id"]]
    clean = {r["doc_id"]: (pii.redacted(r["text"]), r["source"]) for r in rows}
    mixed = spark.createDataFrame([(d, t, s) for d, (t, s) in clean.items()], "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in plan(mixed).collect() if r["copies"]}
    import hashlib

    codec = bpe.codec(*bpe.vocabulary())
    want = []
    for d, n in copies.items():
        ids_, plain = codec.round_trip([clean[d][0]])[0]
        want += [(d, len(ids_) // 4, hashlib.sha256(ids_).hexdigest(), hashlib.sha256(plain).hexdigest())] * n
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
