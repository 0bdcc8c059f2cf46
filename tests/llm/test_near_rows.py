import random
from collections import Counter

import corpus_pipeline


def test_near_dedup_judges_rows_not_ids(spark):
    rng = random.Random(9)
    a, b, c, d, e, f = (" ".join(f"w{rng.randint(0, 9999)}" for _ in range(80)) for _ in range(6))
    wordless = [(None, None), (None, ""), (None, " "), (11, None), (11, None)]
    rows = [(None, a), (None, a), (None, a + " end"), (None, b), (3, c + " end"), (5, c), (5, d), (7, e), (7, e), (None, f), (9, f), *wordless]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    first = [(i, t) for i, t in got.elements() if i is None and t and t.startswith(a)]
    assert len(first) == 1
    assert got == Counter([*first, (None, b), (3, c + " end"), (5, d), (7, e), (9, f), *wordless])
