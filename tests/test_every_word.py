import math
import re

import pytest

from ledgerloom.operators import retrieval


def test_every_prompt_word_counts(spark, tmp_path):
    docs = [(1, "alpha_beta gamma"), (2, "Zürich kit"), (3, "xkitty the long"), (4, None), (5, "beta")]
    asked = [(1, "longest-word extraordinary marvellous kit the"), (2, "alpha_beta, zurich kit"), (3, "no")]
    spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.prompt_id, r["rank"], r.id, r.score) for r in retrieval.r24_all_words(spark, str(tmp_path)).collect())
    folded = {i: (t or "").lower().replace("ü", "u") for i, t in docs}
    want = []
    for p, t in asked:
        terms = {x for w in t.lower().split() if len(x := re.sub(r"[^a-z0-9_]", "", w)) >= 3}
        score = {}
        for w in terms:
            held = [i for i in folded if w in folded[i]]
            for i in held:
                score[i] = score.get(i, 0) + round(math.log((len(docs) + 1) / (len(held) + 1)), 6)
        want += [(p, k + 1, i, pytest.approx(score[i])) for k, i in enumerate(sorted(score, key=lambda i: (-round(score[i], 6), -i)))]
    assert got == want and len(got) == 5
