"""What the workers of an executor take together."""

import numpy as np

from foliospark.llm import words
from foliospark.llm.common import map_batches, map_further
from foliospark.llm.suffix_dedup import dedup_report, dedup_texts, removed_spans


def test_one_worker_for_each_task_of_the_dedup(spark):
    passage = " ".join(f"w{i}" for i in range(90))
    docs = spark.createDataFrame([(1, "head " + passage), (2, passage + " tail"), (3, "other"), (4, None), (5, "")], "doc_id long, text string")
    for ask in (dedup_report, dedup_texts):
        found = ask(removed_spans(spark, docs))
        # from the last shuffle on
        last = found._jdf.queryExecution().sparkPlan().toString().split("Join")[0]
        assert last.count("MapInArrow") == 1, last
        # the same rows as by two maps, one behind the other
        assert sorted(found.collect()) == sorted(ask(removed_spans(spark, docs).select("*")).collect())
    assert dedup_texts(removed_spans(spark, docs)).where("doc_id < 3").orderBy("doc_id").collect() == [(1, "head "), (2, " tail")]


def test_map_further_on_slices(spark):
    rows = spark.range(0, 1000, 1, 2).selectExpr("id", "repeat('x', 100) AS text")
    first = map_batches(rows, lambda b: b if b.column(0)[0].as_py() % 2 == 0 else None, "id long, text string", most_bytes=1)
    got = map_further(first, lambda b: b.select([0]), "id long").collect()
    assert sorted(r.id for r in got) == list(range(0, 1000, 2))


def test_powers_are_kept_once(monkeypatch):
    monkeypatch.setattr(words, "_kept", [np.empty(0, np.uint64)] * 2)
    kept = 0
    for n in (10, 300_000, 70_000, 1 << 20, 3 << 20, 100):
        data = bytes(range(256)) * (-(-n // 256))
        h = words.Hashed(data[:n])
        every = h.every(8)
        assert every[0] == words.Hashed(data[:8]).every(8)[0] and every[-1] == words.Hashed(data[n - 8 : n]).every(8)[0]
        kept = max(kept, n if n < words.KEPT_POWERS else 0)
        assert kept < len(words._kept[0]) <= kept + 65_536
