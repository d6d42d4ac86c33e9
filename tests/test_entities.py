"""Entity mentions against a brute-force reading."""

import random
import re

from tidemark.operators.entities import FINANCE_WORDS, best_mention, entity_mentions, set_scores

ALIASES = "alias string, ticker string, ambiguous boolean"


def brute(text, aliases):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    names = {}
    for a, t, amb in aliases:
        key = tuple(re.findall(r"[^\W_]+", (a or "").lower()))
        if key and t:
            names[key] = min(names.get(key, (t, bool(amb))), (t, bool(amb)))
    spots = sorted((-len(" ".join(n)), i, n) for n in names for i in range(len(w) - len(n) + 1) if tuple(w[i : i + len(n)]) == n)
    claimed, out = set(), set()
    for _, i, n in spots:
        if not claimed & set(range(i, i + len(n))):
            claimed |= set(range(i, i + len(n)))
            near = set(w[max(0, i - 20) : max(0, i - 20) + len(n) + 40])
            t, amb = names[n]
            out.add((i, " ".join(n), t, 0.5 if amb and not near & set(FINANCE_WORDS) else 0.95))
    return out


def test_mentions(spark):
    r = random.Random(2)
    vocabulary = ["alpha", "beta", "gamma", "delta", "shares", "of", "the", "x1"]
    aliases = [("alpha", "A", True), ("Alpha beta", "AB", False), ("beta gamma delta", "BGD", None), ("gamma", "G", True), ("gamma", "B", True), ("", "E", False), (None, "N", False), ("delta", None, False), ("x1", "X", False)]
    texts = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 60)))) for i in range(60)] + [(100, None), (101, ""), (102, "ALPHA-Beta, gamma; alphabet"), (None, "alpha")]
    got = {}
    for x in entity_mentions(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(aliases, ALIASES), id="id", text="text").collect():
        got.setdefault(x.id, set()).add((x.start, x.mention, x.ticker, x.confidence))
    assert got == {i: b for i, t in texts if i is not None and (b := brute(t, aliases))}


def test_empty_and_best_and_scores(spark):
    a = spark.createDataFrame([("alpha", "A", True), ("beta", "B", False)], ALIASES)
    t = spark.createDataFrame([(1, "alpha then beta"), (2, "alpha shares")], "id long, text string")
    m = entity_mentions(t, a, id="id", text="text")
    assert {(x.id, x.ticker) for x in best_mention(m, "id").collect()} == {(1, "B"), (2, "A")}
    s = set_scores(spark.createDataFrame([(1, "B"), (2, "A"), (3, "C")], "id long, ticker string"), m, "id").first()
    assert (s.tp, s.fp, s.fn) == (2, 1, 1) and abs(s.f1 - 2 / 3) < 1e-9
    assert entity_mentions(t.limit(0), a, id="id", text="text").count() == 0 == entity_mentions(t, a.limit(0), id="id", text="text").count()
