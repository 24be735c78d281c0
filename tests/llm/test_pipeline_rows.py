"""The pipeline's stages drop rejected rows and real duplicates only, whatever their ids are."""

import random

import corpus_pipeline
from tests.llm.test_operators import prose
from tests.llm.test_pipeline import SCHEMA


def test_rows_without_or_with_shared_ids(spark, tmp_path):
    rng = random.Random(4)
    good = [prose(rng, 80) for _ in range(70)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, 80).split(" ")) for _ in range(40)]
    item = prose(rng, 40)
    leaky = prose(rng, 60) + " " + item
    rows = [(i, t) for i, t in enumerate(good[:60])] + [(100 + i, t) for i, t in enumerate(bad[:30])]
    rows += [(300, good[60]), (300, bad[30]), (None, bad[31])]  # a good and a bad row of one id; a bad row without one
    rows += [(None, good[61]), (None, good[62]), (301, good[63]), (301, good[64]), (301, good[64])]
    rows += [(None, good[65] + " end"), (302, good[65]), (302, leaky), (None, good[66]), (None, good[66])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x") for i, t in rows], SCHEMA)
    labels = [(i, int(i < 100), 0) for i, _ in rows if i is not None and i < 200]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def after(stage, table):
        table = stage(spark, table, str(tmp_path)).cache()
        return table, sorted(((-1 if r.doc_id is None else r.doc_id), r.text) for r in table.select("doc_id", "text").collect() if r.doc_id is None or r.doc_id >= 100)

    docs, kept = after(corpus_pipeline.quality, docs)
    want = sorted((-1 if i is None else i, t) for i, t in rows if (i is None or i >= 300) and t not in bad)
    assert kept == want
    docs, kept = after(corpus_pipeline.near_duplicates, docs)
    assert kept == sorted(set(want) - {(-1, good[65] + " end")})
    docs, kept = after(corpus_pipeline.decontaminate, docs)
    assert kept == sorted(set(want) - {(-1, good[65] + " end"), (302, leaky)})
