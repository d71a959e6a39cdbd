"""What the rules of the cascade are timed on."""

from brindle.llm import rules


def test_rules_are_timed_on_a_stored_sample(spark, monkeypatch):
    seen, cascade = [], rules.cascade

    def watched(sample, *args):
        seen.append([i.numCachedPartitions() for i in spark.sparkContext._jsc.sc().getRDDStorageInfo()])
        return cascade(sample, *args)

    monkeypatch.setattr(rules, "cascade", watched)
    rules.judge(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert len(seen) == 1 and any(n > 0 for n in seen[0])
