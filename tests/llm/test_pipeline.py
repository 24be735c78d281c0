"""The pipeline's stages on a small table with planted rows."""

import random

import corpus_pipeline
from tests.llm.test_operators import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    good = [prose(rng, 80) for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, 80).split(" ")) for _ in range(30)]
    item, passage = prose(rng, 40), prose(rng, 70)
    rows = [(i, t) for i, t in enumerate(good)] + [(100 + i, t) for i, t in enumerate(bad)]
    rows += [(200, good[0]), (201, good[1] + " end"), (202, prose(rng, 60) + " " + item), (203, prose(rng, 90) + " " + passage), (204, passage + " " + prose(rng, 90)), (205, None), (206, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows if i < 200], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = docs.cache()
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    quality, unique, cut, clean = ids
    assert not quality & set(range(100, 130)) and set(range(60)) <= quality
    assert quality - unique == {200, 201} and cut == unique and cut - clean == {202}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert passage[:200] not in (texts[203] or "") + (texts[204] or "") and texts[5] == good[5]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == clean
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == pieces.count()
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
