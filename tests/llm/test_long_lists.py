"""Inverted lists longer than one block."""

import numpy as np
import pyarrow as pa

from tidemark.llm import words as W
from tidemark.llm.nearest import nearest_in_time
from tidemark.llm.overlaps import CosineLimits, TermWeights, cosine_candidates, cross_split_overlaps, term_weights


def test_long_lists_give_all_pairs(spark):
    rows = [(i, i < 6, f"alpha beta word{'abcdefghijkl'[i]}") for i in range(12)]
    weights = spark.sparkContext.broadcast(TermWeights(np.zeros(0, np.uint64), np.zeros(0, np.float32), 1.0))
    df = spark.createDataFrame(rows, "id long, train boolean, text string")
    for pairs in (1, 7, 1_000_000):
        got = sorted((x.a, x.b) for x in cosine_candidates(df, weights, CosineLimits(pairs=pairs)).collect())
        assert got == [(a, b) for a in range(6) for b in range(6, 12)]


def test_weights_of_frequent_terms_are_exact_and_rare_ones_alike(spark):
    texts = spark.createDataFrame([("alpha beta",), ("alpha gamma",), ("alpha beta delta",), (None,), ("",)], "text string")
    w = term_weights(texts, "text", CosineLimits())
    of = lambda t: float(w.of(W.split(pa.array([t])).hash)[0])
    assert of("alpha") < of("beta") < of("gamma") == of("delta") == of("never")
    few = term_weights(texts, "text", CosineLimits(terms=1))
    assert len(few.known) == 1 and float(few.of(W.split(pa.array(["beta"])).hash)[0]) == few.other
    assert term_weights(texts.limit(0), "text", CosineLimits()).of(np.zeros(2, np.uint64)).tolist() == term_weights(texts.limit(0), "text", CosineLimits()).of(np.ones(2, np.uint64)).tolist()


def test_a_shared_pair_of_figures_alone_is_no_link(spark):
    a = "profits of the mill rose 857.3 percent to 12.6 million after a strong season of exports to the coast"
    b = "857.3 tonnes of tin and 12.6 of lead left harbour on ships bound for foreign yards while crews waited"
    filler = [(10 + i, i % 2 == 0, f"note {'abcdefghijklmnopqrst'[i]} on harbour crews and the season of mill exports number {i} of the year") for i in range(20)]
    df = spark.createDataFrame([(1, True, None, a), (2, False, None, b), (3, False, None, a + " indeed")] + [(i, t, None, x) for i, t, x in filler], "id long, train boolean, title string, body string")
    df = df.selectExpr("id", "if(train, 'train', 'test') as split", "title", "body")
    got = {x.id: x.first for x in cross_split_overlaps(df, id="id", split="split", train="train", title="title", body="body").collect()}
    assert got.get(3) == got.get(1) == 1 and got.get(2, 2) != 1


def test_slots_hold_every_term():
    r = np.random.default_rng(1)
    known = np.unique(r.integers(1, 1 << 63, 20_000, dtype=np.int64).view(np.uint64))
    w = TermWeights(known, np.arange(len(known), dtype=np.float32), -1.0)
    assert (w.of(known) == np.arange(len(known))).all() and (w.of(known + np.uint64(1))[~np.isin(known + np.uint64(1), known)] == -1).all()


def test_nearest_with_a_hot_entity_and_a_larger_right_table(spark):
    """Blocks cut into pieces give the same pairs as uncut ones."""
    r = np.random.default_rng(3)
    at = lambda n: [int(x) for x in r.integers(0, 40 * 86400, n)]
    left = spark.createDataFrame([(i, "hot" if i % 4 else f"e{i % 9}", t) for i, t in enumerate(at(400))], "id long, e string, t long").selectExpr("id", "e", "timestamp_seconds(t) as t")
    right = spark.createDataFrame([(i, "hot" if i % 4 else f"e{i % 9}", t) for i, t in enumerate(at(6000))], "id long, e string, t long").selectExpr("id", "e", "timestamp_seconds(t) as t")
    args = dict(left_id="id", left_entity="e", left_time="t", right_id="rid", right_entity="e", right_time="t", tolerance_seconds=7200)
    run = lambda n: sorted(tuple(x) for x in nearest_in_time(left, right.withColumnRenamed("id", "rid"), rows_per_group=n, **args).collect())
    assert run(50) == run(1_000_000) and len(run(50)) > 300
