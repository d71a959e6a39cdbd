"""The pipeline's near-duplicates against all pairs."""

import random

import corpus_pipeline
from brindle.llm import near


def test_stage_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(4)
    base = [rng.choice(("alpha", "beta", "gamma", "delta", "omega")) + str(rng.randrange(900)) for _ in range(400)]
    made = []
    for k in range(60):
        words = list(base)
        for at in rng.sample(range(400), rng.randrange(1, 12)):
            words[at] = f"edit{k}"
        made.append((100_000 + k, " ".join(words), "en", "made", 0))
    made += [(200_000, "", "en", "made", 0), (200_001, None, "en", "made", 0), (200_002, "One two", "en", "made", 0), (200_003, "one  TWO", "en", "made", 0), (200_000, "other text under the same id", "en", "made", 0)]
    both = docs.unionByName(spark.createDataFrame(made, docs.schema))
    rows = both.collect()
    sets, holders = [near.shingles(r["text"]) for r in rows], {}
    for k, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(k)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = 0
    for a, s in enumerate(sets):
        for b in {b for g in s for b in holders[g] if b > a}:
            if near.jaccard(s, sets[b]) >= 0.8:
                linked += s != sets[b]
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert linked > 12
    least = {}
    for k, r in enumerate(rows):
        least[root(k)] = min(least.get(root(k), r["doc_id"]), r["doc_id"])
    want = sorted((r["doc_id"], least[root(k)]) for k, r in enumerate(rows))
    assert sorted((r["doc_id"], r["component_id"]) for r in near.components(both).collect()) == want
    kept = corpus_pipeline.drop_near_duplicates(spark, both, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())


def test_run_keeps_one_of_each_similar_group(spark):
    """The whole pipeline on sf0.001, where two pairs at 0.83 lie 7 and 11 bits apart."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.reject_toxic(spark, docs, sf).collect()
    sets, parent = {r["doc_id"]: near.shingles(r["text"]) for r in kept}, {r["doc_id"]: r["doc_id"] for r in kept}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and near.jaccard(sets[a], sets[b]) >= 0.8:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    one = docs.where(docs["doc_id"].isin([d for d in parent if root(d) == d]))
    mixed = corpus_pipeline.mix_sources(spark, corpus_pipeline.redact_personal_data(spark, one, sf), sf)
    want = corpus_pipeline.encode_tokens(spark, mixed, sf)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, want.collect()))
