"""Words that resemble each other, against brute force."""

import random
from itertools import product

from pyspark.sql import functions as F

from tidemark.llm.mapping import NameLimits, _deletions, close_words, grams


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_close_words_match_brute_force(spark):
    r, limits = random.Random(4), NameLimits()
    word = lambda: "".join(r.choice(["cal", "gri", "nel", "pyr", "mo", "a"]) for _ in range(r.randrange(1, 7)))
    slip = lambda w: "".join(c for c in w if r.random() > 0.1) + r.choice(["", "", "x"])
    right = {word() for _ in range(70)}
    left = {w for w in (slip(r.choice(sorted(right))) if r.random() < 0.7 else word() for _ in range(120)) if len(w) >= 4}
    make = lambda s: spark.createDataFrame([(x,) for x in sorted(s)], "key string").withColumn("tokens", grams(F.col("key")))
    tri = lambda w: (lambda p: {p[i : i + 3] for i in range(len(p) - 2)})("^^" + w + "$$")
    want = {(a, b, d) for a, b in product(left, right) if (d := distance(a, b)) <= limits.edits and d * 3 <= len(a) and len(tri(a) & tri(b)) / len(tri(a) | tri(b)) >= limits.jaccard}
    got = [(x.l, x.r, x.edits) for x in close_words(make(left), make(right), limits).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {len(a) > 12 for a, _, _ in want} == {True, False}


def test_words_with_a_common_syllable_alone_never_meet(spark):
    words = spark.createDataFrame([("cal" + w,) for w in ("grinel", "mopyrs", "dortuv", "wexfen")], "key string")
    assert _deletions(words, F.lit(3), 3).groupBy("rest").count().where("count > 1").count() == 0
