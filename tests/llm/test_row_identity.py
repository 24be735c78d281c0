"""Rows with null ids, and different texts under one id, keep their own sets and links."""

import random

from foliospark.llm.ngram_join import jaccard_components
from tests.llm.test_operators import brute_components, prose


def near(text, *places):
    words = text.split(" ")
    for i in places:
        words[i] = f"changed{i}"
    return " ".join(words)


def test_jaccard_of_shared_and_missing_ids(spark):
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 120) for _ in range(4))
    rows = [(5, a), (5, b), (2, near(b, 60)), (9, near(a, 30)), (5, b)]  # one id, two texts, each with a partner
    rows += [(20, c), (None, near(c, 20)), (21, near(c, 20, 60)), (22, near(c, 20, 60, 100))]  # a chain through a null id
    rows += [(None, d), (None, near(d, 50)), (None, None), (30, "")]
    got = jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    far = 1 << 40  # brute force with an id above all others where there is none
    want = brute_components([(far if i is None else i, t or "") for i, t in rows])
    assert sorted((far if r.doc_id is None else r.doc_id, r.n_shingles, far if r.component_id is None else r.component_id) for r in got) == want
