"""Items that stand in the evaluation set more than once, or nearly so."""

import random

from tidemark.llm import leaks as L


def test_repeated_items(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(3))
    text, other = [word() for _ in range(60)], [word() for _ in range(60)]
    near = [word() if k % 20 == 19 else w for k, w in enumerate(text)]
    items = [(1, " ".join(text)), (2, " ".join(text).upper()), (3, " ".join(near)), (4, " ".join(other)), (4, " ".join(other))]
    docs = [(10, " ".join([word() for _ in range(30)] + text + [word() for _ in range(30)])), (11, " ".join(other)), (12, " ".join(word() for _ in range(90)))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = L.leaked_items(d, i, doc_id="doc_id", doc_text="text", item_id="item_id", item_text="text").collect()
    assert sorted((x.doc_id, x.item_id) for x in got) == [(10, 1), (10, 2), (10, 3), (11, 4)]
