import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from attestary.llm import simhash
from attestary.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    d = table(spark, SF, "documents")
    columns, before = d.columns, d
    for name, stage in corpus_pipeline.STAGES:
        d = written(stage(spark, before, SF), f"test-{name}")
        if name != "packing":
            assert d.columns == columns
            assert d.join(before.select("doc_id"), "doc_id", "left_anti").isEmpty()
            assert 0 < d.count() <= before.count()
        if name == "simhash":  # one of each group, and no group is lost
            prints = lambda x: np.array([simhash.fingerprint((r.text or "").encode()) for r in x.collect()], np.uint64)
            old, new = prints(before), prints(d)
            assert len(np.unique(new)) == len(new)
            assert not any((np.bitwise_count(np.delete(new, i) ^ p) <= 4).any() for i, p in enumerate(new))
            assert all(p in new or (np.bitwise_count(old ^ p) <= 4).sum() > 1 for p in old)
        if name == "packing":
            assert {r.doc_id for r in d.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}
        before = d


def test_run_equals_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.agg(F.min("offset")).first()[0] == 0
