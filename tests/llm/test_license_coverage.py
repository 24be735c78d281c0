"""Texts at the stated coverage are found whatever words are lost or added."""

import random

from foliospark.llm.licenses import TEMPLATES, license_scan
from tests.llm.test_operators import prose


def test_every_template_at_its_coverage(spark):
    rng = random.Random(8)
    rows, want = [(0, "Released under MIT License.")], {(0, 0)}
    for p, (_, text) in enumerate(TEMPLATES):
        words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()
        for way in ("changed", "added", "lost"):
            new = list(words)
            if way == "added":
                new = [x for w in words[:8] for x in (w, "zz")] + words[8:]
            elif way == "changed":
                new[3::4] = ["zz"] * len(new[3::4])
            else:
                for i in sorted(range(1, len(new), 4), reverse=True)[: len(words) // 4]:
                    del new[i]
            rows.append((len(rows), prose(rng, 40) + " " + " ".join(new) + " " + prose(rng, 40)))
            want.add((rows[-1][0], p))
    got = {(r.doc_id, r.template) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= got, want - got
