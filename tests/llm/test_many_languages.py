"""More languages than one sample used to hold."""

import random

from accountgraph.llm import language


def test_every_language_is_learned(spark):
    rng = random.Random(3)
    rows = []
    for k in range(40):
        sign = chr(0x4E00 + 150 * k)
        rows += [(100 * k + i, "".join(rng.choice([sign, chr(ord(sign) + 1), " "]) for _ in range(60)), f"l{k:02d}") for i in range(12 - (k > 33) * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = language.train(docs)
    assert network.languages == [f"l{k:02d}" for k in range(40)]
    assert network.bias.shape == (40,)
    found = language.predicted(docs, network).join(docs, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.98 * len(found)
