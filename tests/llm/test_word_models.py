"""Word bigram models against a count by hand."""

import re
from collections import Counter

import numpy as np

from foliospark.llm import lm_scores, queries
from foliospark.llm.lm_scores import PRIOR, word_cross_entropy_difference
from tests.llm.test_operators import docs, empty, texts_by_id  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(rows, target):
    split = [(d, [None, *WORD.findall(t.translate(LOW))]) for d, t in rows]
    kept, all_of = [x for d, x in split if d in target], [x for _, x in split]
    sizes = [sum(len(x) - 1 for x in y) for y in (kept, all_of)]
    vocabulary, share = len({w for x in all_of for w in x[1:]}), sizes[0] / max(1, sizes[1])

    def model(texts, scale):
        count, pair = Counter(), Counter()
        for x in texts:
            count.update(x if len(x) > 1 else [])
            pair.update(zip(x, x[1:]))
        words = {w: n for w, n in count.items() if w is not None}
        kinds, total = sum(1 - (1 - scale) ** n for n in words.values()), scale * sum(words.values())

        def bits(x):
            out = 0.0
            for v, w in zip(x, x[1:]):
                p = (scale * count[w] + kinds / vocabulary) / (total + kinds) if total else 1 / vocabulary
                out -= np.log2((scale * pair[v, w] + PRIOR * p) / (scale * count[v] + PRIOR))
            return out / max(1, len(x) - 1)

        return bits

    t, b = model(kept, 1), model(all_of, share)
    return sorted((d if d is not None else -1, len(x) - 1, round(t(x), 6), round(b(x), 6)) for d, x in split)


def test_word_models(spark, docs, empty, monkeypatch):  # noqa: F811
    monkeypatch.setattr(lm_scores, "GRAM_BLOCK_BYTES", 1 << 12)
    rows = [*texts_by_id(docs), (None, "one two three"), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    rows = [(d, t or "") for d, t in rows]
    for target in ([6, 7, None, 999], [], [999], [d for d, _ in rows]):
        got = word_cross_entropy_difference(spark, table, spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, round(r.target_bits, 6), round(r.background_bits, 6)) for r in got) == brute(rows, set(target) - {None})
    assert word_cross_entropy_difference(spark, empty, table).collect() == []


def test_registered_models_know_phrasing(spark, tmp_path):
    """The same words in two orders: the word pairs tell them apart, whatever letters they have."""
    good, other = "ab cd ab cd ab cd", "ab ab ab cd cd cd"
    spark.createDataFrame([(1, good), (2, good), (3, other), (4, other), (5, good)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op6_lm_scores(spark, str(tmp_path)).collect()}
    assert {d for d, r in got.items() if r.prefers_target} == {1, 2, 5} and {r.n_tokens for r in got.values()} == {6}
