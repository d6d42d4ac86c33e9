"""Operators for training data: brute force, held-out accuracy and edge cases on small frames."""

import datetime as dt
import random
import re
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import abuse as A
from tidemark.llm import leaks as L
from tidemark.llm import words as W
from tidemark.llm.components import components
from tidemark.llm.dedup import ArticleStore, page_key
from tidemark.llm.mapping import grams, map_names, similar_sets
from tidemark.llm.mixing import mix_sources, source_key
from tidemark.llm.nearest import nearest_in_time
from tidemark.llm.overlaps import cross_split_overlaps

# Words


def spell(text):
    w = W.split(W.plain(pa.array([text])))
    return [w.text(i) for i in range(len(w.start))]


def test_words():
    assert spell("It's $1,234.50 (Café), no.7 a.b") == ["it's", "1,234.50", "cafe", "no", "7", "a", "b"]
    h = lambda t: W.split(W.plain(pa.array([t]))).hash.tolist()
    assert h("1,234.5") == h("1234.5") != h("12345")
    assert h("ABC def") == h("abc  DEF!")
    w = W.split(W.plain(pa.array([None, "", "x y", "z"])))
    assert w.first.tolist() == [0, 0, 0, 2, 3] and w.row.tolist() == [2, 2, 3]
    assert W.split(W.plain(pa.array([], pa.string()))).first.tolist() == [0]


def test_words_do_not_depend_on_their_batch():
    texts = ["alpha 12.5 beta", "x" * 5000, None, "Ünïcode straße 7,000", "alpha 12.5 beta"]
    all_ = W.split(W.plain(pa.array(texts)))
    one = [W.split(W.plain(pa.array([t]))).hash.tolist() for t in texts]
    assert [all_.hash[all_.first[i] : all_.first[i + 1]].tolist() for i in range(5)] == one
    h, row, first = W.split_joined(W.plain(pa.array(["The end.", "a 2.5% b", "  ", "the END"])))
    assert h[first[0] : first[1]].tolist() == h[first[3] : first[4]].tolist() and first.tolist() == [0, 2, 5, 5, 7]
    assert all_.texts().to_pylist()[:3] == ["alpha", "12.5", "beta"]


# Components


def test_components_match_union_find(spark):
    r = random.Random(4)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.id: x.first for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Problem 4

NEWS = "news_id long, url string, title string, body string, ticker string, day int"
BODY = "Sales rose to $617.1 million in Galbel. Costs ran 22.0 percent over budget because pricing stayed better. The deal values the division at $784.3 million, or 163.11 a share."


def article(i, rng):
    f = lambda: f"{rng.randrange(100, 999)}.{rng.randrange(1, 9)}"
    return f"Firm {i} wins order of {f()}", f"Revenue of unit {i} came to ${f()} million against {f()} before. Debt stood at {f()} after talks in town {i}. Shares fell to {f()} in early trading."


def ingest(spark, path, rows, parts):
    store, out = ArticleStore(spark, str(path)), {}
    df = spark.createDataFrame(rows, NEWS)
    for lo, hi in parts:
        for x in store.ingest(df.where(F.col("news_id").between(lo, hi)), id="news_id", url="url", title="title", body="body").collect():
            out[x.id] = x.first
    return out


def test_store_reopened(spark, tmp_path):
    """A second store on the path goes on where the first stopped; nothing is overwritten."""
    cols = dict(id="news_id", url="url", title="title", body="body")
    one = spark.createDataFrame([(1, "https://a.example/1", "Firm opens plant in Galbel", BODY, "X", 1)], NEWS)
    two = spark.createDataFrame([(2, "https://b.example/2", None, BODY, "X", 1)], NEWS)
    path = str(tmp_path / "store")
    assert ArticleStore(spark, path).ingest(one, **cols).count() == 0
    (tmp_path / "store" / "features-000001-broken").mkdir()  # a delivery that failed
    again = ArticleStore(spark.newSession(), path)
    assert [tuple(x) for x in again.ingest(two, **cols).collect()] == [(2, 1)]
    assert len(ArticleStore(spark, path).parts()) == 2
    assert [tuple(x) for x in ArticleStore(spark, path).articles().collect()] == [(2, 1)]


def test_store_merges_articles_known_before(spark, tmp_path):
    """A page that brings the text of another article makes both one; later rows find the lowest id."""
    other = BODY.replace("617.1", "931.4").replace("22.0", "13.7").replace("784.3", "402.9").replace("163.11", "88.02")
    cols = dict(id="news_id", url="url", title="title", body="body")
    rows = [(1, "https://a.example/1", "Firm opens plant", BODY, "X", 1), (2, "https://b.example/2", None, other, "X", 1), (3, "https://a.example/1", None, other, "X", 1), (4, "https://c.example/4", None, other + " More.", "X", 1)]
    store = ArticleStore(spark, str(tmp_path / "store"))
    got = [sorted(tuple(x) for x in store.ingest(spark.createDataFrame([r], NEWS), **cols).collect()) for r in rows]
    assert got == [[], [], [(3, 1)], [(4, 1)]]
    assert sorted(tuple(x) for x in store.articles().collect()) == [(2, 1), (3, 1), (4, 1)]


def test_page_key(spark):
    urls = ["https://www.A.example/x/?utm_source=q&utm_medium=r", "http://m.a.example/x#top", "https://A.EXAMPLE/x", "https://a.example/x?id=1&ref=home", "https://a.example/x?id=1", None, ""]
    got = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(page_key(F.col("u"))).collect()]
    assert got[0] == got[1] == got[2] == "a.example/x" and got[3] == got[4] == "a.example/x?id=1" and got[5:] == [None, None]


def test_dedup_kinds(spark, tmp_path):
    other = BODY.replace("617.1", "931.4").replace("22.0", "13.7").replace("784.3", "402.9").replace("163.11", "88.02")
    rows = [
        (1, "https://a.example/1", "Firm opens plant in Galbel", BODY, "X", 1),
        (2, "https://www.a.example/1?ref=home", None, None, "X", 1),  # same page
        (3, "https://b.example/2", "FIRM OPENS PLANT IN GALBEL", BODY.upper().replace("$", "USD "), "X", 1),  # same text
        (4, "https://c.example/3", "Other words here", BODY.replace("pricing", "priicng"), None, 1),  # edited
        (5, "https://d.example/4", None, BODY.split(". ")[2], None, 1),  # a part
        (6, "https://e.example/5", "Firm opens plant in Galbel again", other, "X", 1),  # figures of its own
        (7, "https://f.example/6", "Firm opens plant in Galbl", "", "X", 1),  # title with a slip
        (8, "https://g.example/7", "", None, None, 1),
        (9, "https://h.example/8", "Daily report", BODY.replace("617.1", "555.5").replace("22.0", "9.5").replace("784.3", "12.25").replace("163.11", "71.8"), None, 1),
        (10, "https://i.example/9", "Daily report", other.replace("931.4", "777.7").replace("402.9", "303.3").replace("13.7", "17.3").replace("88.02", "91.6"), None, 1),
        (11, "https://j.example/10", "Daily report", None, None, 1),  # a title over two articles decides nothing
        (12, None, None, None, None, 1),
    ]
    assert ingest(spark, tmp_path / "s", rows, [(1, 99)]) == {2: 1, 3: 1, 4: 1, 5: 1, 7: 1}


def test_deliveries_one_by_one_or_at_once(spark, tmp_path):
    rng, rows = random.Random(9), []
    base = [article(i, rng) for i in range(12)]
    for k in range(40):
        i = rng.randrange(12)
        title, body = base[i]
        parts = body.split(". ")
        kind = rng.randrange(4)
        body = body if kind == 0 else ". ".join(parts[:2]) if kind == 1 else body.replace("early", "erly") if kind == 2 else body.upper()
        rows.append((k, f"https://s{k}.example/p", title, body, "T", 0))
    whole = ingest(spark, tmp_path / "a", rows, [(0, 99)])
    steps = ingest(spark, tmp_path / "b", rows, [(0, 9), (10, 10), (11, 24), (25, 99)])
    assert whole == steps
    first = {}
    for r in rows:
        first.setdefault(r[2], r[0])
    assert whole == {r[0]: first[r[2]] for r in rows if first[r[2]] != r[0]}
    assert ingest(spark, tmp_path / "c", [], [(0, 99)]) == {}


def test_truncated_copy_without_figures(spark, tmp_path):
    start = "Talks between the lenders and the board of the Galbel works went on after the summer break without any result."
    rows = [
        (1, "https://a.example/1", "Lenders meet", start + " Revenue came to $617.1 million against 593.2 before.", "X", 1),
        (2, "https://b.example/2", "No result yet", start, "X", 1),  # its figures are cut off
        (4, "https://d.example/4", "Other talks", "Talks between the owners and a union of the Pelmel yard were put off until spring.", "X", 1),
    ]
    assert ingest(spark, tmp_path / "a", rows, [(1, 9)]) == {2: 1}
    assert ingest(spark, tmp_path / "b", rows, [(1, 1), (2, 9)]) == {2: 1}


# Problem 5


def test_overlaps_between_splits(spark):
    rng = random.Random(2)
    base = [article(i, rng) for i in range(30)]
    rows = [(i, "train", t, b) for i, (t, b) in enumerate(base)]
    rows += [(100, "test", base[3][0], base[3][1].replace("early", "eraly")), (101, "test", None, base[4][1].upper()), (102, "validation", base[5][0], None), (103, "test", *article(99, rng)), (104, None, *base[6]), (105, "test", None, ""), (106, "test", *base[3])]
    df = spark.createDataFrame(rows, "id long, split string, title string, body string")
    got = {x.id: x.first for x in cross_split_overlaps(df, id="id", split="split", train="train", title="title", body="body").collect()}
    assert got == {3: 3, 100: 3, 106: 3, 4: 4, 101: 4, 5: 5, 102: 5}


# Problem 6


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("threshold", [0.28, 0.5, 0.9])
def test_similar_sets_match_brute_force(spark, threshold):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randrange(3, 9)))
    left, right = {word() for _ in range(60)}, {word() for _ in range(60)}
    make = lambda s: spark.createDataFrame([(x,) for x in sorted(s)], "key string").withColumn("tokens", grams(F.col("key")))
    tri = lambda w: (lambda p: {p[i : i + 3] for i in range(len(p) - 2)})("^^" + w + "$$")
    want = {(a, b) for a, b in product(left, right) if jaccard(tri(a), tri(b)) >= threshold}
    assert {(x.l, x.r) for x in similar_sets(make(left), make(right), threshold).collect()} == want
    assert similar_sets(make(left).limit(0), make(right), threshold).count() == 0


def test_names(spark):
    firms = [("AAAAA", "Calmontuv Wexpyrfyr Foods SA"), ("BBBBB", "Pelpelmel Fenkynver Aerospace Ltd"), ("CCCCC", "Pelpelmel Fenkynver Insurance Group")]
    cases = {
        "calmontuv wexpyrfyr": "AAAAA", "Ca1m0ntuv Wexpyrfyr": "AAAAA", "WEXPYRFYR CALMONTUV": "AAAAA", "Calmontuvwexpyrfyr Foods": "AAAAA", "the Cálmöntuv-Wexpyrfyr Fds Co.": "AAAAA", "Calmon. Wexpyrfyr Foods": "AAAAA",
        "C. Wexpyrfyr Foods": "AAAAA", "Calmnotuv Wexpyrfry": "AAAAA", "Pelpelmel Fenkynver Aerosp.": "BBBBB", "Pelpelmel Fenkynver Insur.": "CCCCC", "$BBBBB": "BBBBB", "XNV:CCCCC": "CCCCC", "ccccc": "NONE", "$BBBBA": "NONE",
        "Calmontuv Rostriral Foods": "NONE", "Wexpyrfyr": "NONE", "": "NONE", "the old firm": "AAAAA",
    }
    titles = {"Shares in Calmontuv Wexpyrfyr end at 3.4": "AAAAA", "Market wrap": "NONE", "BBBBB lifts outlook": "BBBBB", "x " * 4000 + "Pelpelmel Fenkynver Insurance": "CCCCC"}
    rows = [(i, t, True) for i, t in enumerate(cases)] + [(i, t, False) for i, t in enumerate(titles)] + [(900, None, True)]
    got = map_names(spark.createDataFrame(rows, "id long, text string, whole boolean"), spark.createDataFrame(firms, "ticker string, company string"), spark.createDataFrame([("old firm", "AAAAA"), (None, "BBBBB")], "alias string, ticker string")).collect()
    found = {(x.whole, x.id): x.ticker for x in got}
    assert {t: found[True, i] for i, t in enumerate(cases)} == cases
    assert {t[-30:]: found[False, i] for i, t in enumerate(titles)} == {t[-30:]: v for t, v in titles.items()}
    assert found[True, 900] == "NONE" and len(found) == len(rows)


# Problem 7


def test_nearest_matches_brute_force(spark):
    r = random.Random(6)
    t = lambda: dt.datetime(2025, 1, 1) + dt.timedelta(minutes=r.randrange(60 * 24 * 60))
    left = [(i, r.choice(["a", "b", "c", None]), t(), "x") for i in range(200)] + [(900, "a", None, "x")]
    right = [(i, r.choice("ab"), t(), "y") for i in range(60)]
    right += [(1000 + i, e, ts, "y") for i, (_, e, ts, _) in enumerate(right[:10])]
    args = {"left_id": "id", "left_entity": "e", "left_time": "t", "right_id": "id", "right_entity": "e", "right_time": "t", "tolerance_seconds": 20 * 3600, "block_days": 2}
    make = lambda x: spark.createDataFrame(x, "id long, e string, t timestamp, extra string")
    out = nearest_in_time(make(left), make(right).withColumnRenamed("id", "rid"), **{**args, "right_id": "rid"})
    want = {}
    for i, e, ts, _ in left:
        ok = [(abs(ts - rt), rt, k) for k, f, rt, _ in right if f == e and ts and abs(ts - rt) <= dt.timedelta(hours=20)]
        if ok:
            want[i] = min(ok)[2]
    assert {x.id: x.rid for x in out.collect()} == want
    assert nearest_in_time(make([]), make(right).withColumnRenamed("id", "rid"), **{**args, "right_id": "rid"}).count() == 0
    assert nearest_in_time(make(left), make([]).withColumnRenamed("id", "rid"), **{**args, "right_id": "rid"}).count() == 0


# Problem 8


def test_automaton_matches_brute_force():
    r = random.Random(8)
    seqs = [[r.randrange(4) for _ in range(r.randrange(1, 30))] for _ in range(6)]
    text = [r.randrange(5) for _ in range(200)]
    a = L.SuffixAutomaton(seqs)
    inside = lambda s: any(s == q[i : i + len(s)] for q in seqs for i in range(len(q) - len(s) + 1))
    longest = [max(n for n in range(i + 2) if inside(text[i + 1 - n : i + 1])) for i in range(len(text))]
    want = [(i, n) for i, n in enumerate(longest) if n >= 3 and (i + 1 == len(text) or longest[i + 1] != n + 1)]
    got = a.matches(text, 3)
    assert [(e, n) for e, n, _ in got] == want
    flat = [x for s in seqs for x in s]
    for end, n, s in got:
        places = a.order[a.lo[s] : a.hi[s]]
        hits = [e for k, q in enumerate(seqs) for e in range(a.starts[k] + n - 1, a.starts[k] + len(q)) if flat[e - n + 1 : e + 1] == text[end - n + 1 : end + 1]]
        assert sorted(places) == hits


def test_leaks(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(3))
    item = [[word() for _ in range(60)] for _ in range(5)]
    noise = lambda n: [word() for _ in range(n)]
    notice = noise(12)
    items = [(i, " ".join(w + notice)) for i, w in enumerate(item)] + [(90, None), (91, ""), (92, "one two")]
    changed = [word() if k % 10 == 9 else w for k, w in enumerate(item[2])]
    docs = [
        (1, " ".join(noise(50) + item[0][10:45] + noise(3000))),
        (2, " ".join(w.upper() + "," for w in item[1][:20]) + "\n<br>" + " ".join(noise(30) + item[1][40:60])),
        (3, " ".join(noise(10) + changed + noise(10))),
        (4, " ".join(noise(20) + item[3][5:15] + noise(20))),  # a short quotation
        (5, " ".join(noise(40) + notice + noise(40))),  # a standing notice
        (6, None), (7, ""), (8, " ".join(item[4])), (8, " ".join(item[4])),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    found = lambda lim: sorted((x.doc_id, x.item_id) for x in L.leaked_items(d, i, doc_id="doc_id", doc_text="text", item_id="item_id", item_text="text", limits=lim).collect())
    assert found(L.LeakLimits()) == [(1, 0), (2, 1), (3, 2), (8, 4), (8, 4)]
    # In shards of one item the notice is no more told from the items' own words: they still all come out.
    assert set(found(L.LeakLimits())) <= set(found(L.LeakLimits(shard_words=80)))
    assert L.leaked_items(d.limit(0), i, doc_id="doc_id", doc_text="text", item_id="item_id", item_text="text").count() == 0
    assert L.leaked_items(d, i.limit(0), doc_id="doc_id", doc_text="text", item_id="item_id", item_text="text").count() == 0


# Problem 9


def test_leaks_of_items_with_much_common_wording(spark):
    """Items made of sentences that stand in other items too, but for a figure each: whole copies come out, lone sentences don't."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(3))
    frames = [[word() for _ in range(11)] for _ in range(12)]
    fill = lambda f: f[:6] + [str(r.randrange(10**6))] + f[6:]
    text = lambda: [w for f in r.sample(frames, 6) for w in fill(f)]
    item = [text() for _ in range(8)]
    docs = [(k, text() + text() + item[k][5:60] + text()) for k in range(8)] + [(50 + k, text() + text() + item[k][24:36] + text()) for k in range(8)] + [(90, text() * 4)]
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(item)], "item_id long, text string")
    got = L.leaked_items(d, i, doc_id="doc_id", doc_text="text", item_id="item_id", item_text="text").collect()
    assert sorted((x.doc_id, x.item_id) for x in got) == [(k, k) for k in range(8)]


def test_mixture_meets_budgets(spark):
    r = random.Random(1)
    docs = [(i, s, r.randrange(1, 40)) for i, s in enumerate(["big"] * 4000 + ["mid"] * 300 + ["small"] * 20 + ["other"] * 50)] + [(90_000, None, 5), (90_001, "mid", 0), (90_002, "mid", None)]
    goals = [("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.15, 4), ("ghost", 0.05, 2)]
    sized, targets = spark.createDataFrame(docs, "doc_id long, source string, tokens long"), spark.createDataFrame(goals, "source string, weight double, max_repeats int")
    total = 20_000
    mix, report = mix_sources(sized, targets, id="doc_id", total_tokens=total, slice_rows=100)
    size = {i: n for i, _, n in docs}
    taken = {}
    for x in mix.collect():
        assert 1 <= x.repeats <= dict((s, c) for s, _, c in goals)[x.source]
        taken[x.source] = taken.get(x.source, 0) + size[x.doc_id] * x.repeats
    have = {s: sum(n or 0 for _, q, n in docs if q == s) for s, _, _ in goals}
    for s, w, cap in goals:
        assert abs(taken.get(s, 0) - min(w * total, cap * have[s])) <= 20.5
    rep = {x.source: x for x in report.collect()}
    assert rep["ghost"].gap == pytest.approx(0.05) and rep["ghost"].taken_tokens == 0
    assert sum(x.actual_share for x in rep.values()) == pytest.approx(1, abs=1e-4)
    again, _ = mix_sources(sized.repartition(7), targets, id="doc_id", total_tokens=total, slice_rows=5000)
    assert sum(size[x.doc_id] * x.repeats for x in again.collect()) == pytest.approx(sum(taken.values()), abs=60)
    empty, rep = mix_sources(sized.limit(0), targets, id="doc_id")
    assert empty.count() == 0 and rep.count() == 4


def test_source_spellings(spark):
    df = spark.createDataFrame([("Desk_Notes",), (" desk-notes ",), ("DESK notes",), (" ",), (None,)], "s string")
    assert {r[0] for r in df.select(source_key(F.col("s"))).collect()} == {"desk-notes", None}


# Problem 10


def test_gradients_are_right():
    tokens = ["a", "b", "cc", "dd", "<pad>"]
    net = A.Network({"a": 1, "b": 2}).start(dim=3, hidden=2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x, y, w = r.integers(0, 5, (4, A.WINDOW)), np.array([1.0, 0, 1, 0]), np.ones(4)
    pieces = net.pieces(tokens)
    _, g = net.gradients(pieces, x, y, w)
    for k in ("Wf", "Ub", "cf", "A", "v", "u", "o", "word"):
        at = tuple(r.integers(0, n) for n in net.p[k].shape)
        at = (1, *at[1:]) if k == "word" else at
        old = net.p[k][at]
        side = []
        for e in (1e-5, -1e-5):
            net.p[k][at] = old + e
            side.append(net.gradients(pieces, x, y, w)[0])
        net.p[k][at] = old
        assert g[k][at] == pytest.approx((side[0] - side[1]) / 2e-5, rel=1e-2, abs=1e-5)


def test_windows_cover_every_token():
    for n in (0, 1, A.WINDOW, A.WINDOW + 1, 100):
        row, begin = A.windows(np.array([0, 3, 3 + n]))
        seen = {t for q, b in zip(row, begin) if q == 1 for t in range(b, min(b + A.WINDOW, 3 + n))}
        assert seen == set(range(3, 3 + n))


def test_canonical_spellings():
    assert A.canonical("fuuuuck!!!") == "fuck" and A.canonical("sh1t,") == "shit" and A.canonical("c**k") == "c*k" and A.canonical("$4.5") == "<num>" and A.canonical("--") == ""
    assert A.token_lists(pa.array(["nudе b-a-d", None, "..."]))[2][:1] == ["nude"]


@pytest.fixture(scope="module")
def network(spark, data):
    rated = [(r.text, r.rating != "none") for r in spark.read.parquet(f"{data}/rated_texts.parquet").collect()]
    docs = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rng = random.Random(0)
    rng.shuffle(rated)
    return A.train(rated[:210], docs), rated[210:]


def test_held_out_accuracy(network):
    net, held = network
    s = net.score_column(pa.array([t for t, _ in held]))
    y = np.array([v for _, v in held])
    assert ((s >= 0.98) == y).mean() >= 0.9


def test_scores_of_all_rows(spark, network):
    net, _ = network
    long = "the company expects sales to rise in may " * 3000
    df = spark.createDataFrame([(1, None), (2, ""), (3, long), (4, long + " shut your mouth you fucking moron " + long), (4, "..."), (None, "fine")], "doc_id long, text string")
    got = A.score_texts(df, net, id="doc_id", text="text").collect()
    assert len(got) == 6
    s = sorted((x.doc_id or 0, x.abuse_score) for x in got)
    assert s[1] == (1, 0.0) and s[2] == (2, 0.0) and max(v for k, v in s if k == 4) > 0.9 > 0.5 > max(v for k, v in s if k == 3)
    assert A.score_texts(df.limit(0), net, id="doc_id", text="text").count() == 0


def test_abuse_on_rated_texts_held_out(data):
    """A third of the rated texts is kept back, whole wordings at a time: of wordings never seen, over half are found."""
    import pyarrow.parquet as pq

    rated = pq.read_table(f"{data}/rated_texts.parquet").to_pylist()
    documents = [t for t in pq.read_table(f"{data}/documents.parquet")["text"].to_pylist() if t]
    held = lambda t: zlib.crc32(" ".join(sorted(t.lower().split()[:3])).encode()) % 3 == 0
    net = A.train([(x["text"], x["rating"] != "none") for x in rated if not held(x["text"])], documents, copies=4000, hard=2000)
    test = [x for x in rated if held(x["text"])]
    score = net.score_column(pa.array([x["text"] for x in test]))
    hit = sum(s >= 0.7 and x["rating"] != "none" for s, x in zip(score, test))
    wrong = sum(s >= 0.7 and x["rating"] == "none" for s, x in zip(score, test))
    bad = sum(x["rating"] != "none" for x in test)
    assert bad >= 20 and hit >= 0.5 * bad and wrong <= 0.1 * (len(test) - bad)


def test_no_seed_stands_in_the_documents(data):
    """No seed sentence may share four successive words with a document to be scored."""
    import pyarrow.parquet as pq

    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    fours = lambda w: set(zip(w, w[1:], w[2:], w[3:]))
    seeds = set()
    for s in [*(s for kind in A._SEEDS.values() for s in kind), *A._CLEAN]:
        for part in re.split(r"\{[ig]\}", s):
            seeds |= fours(words(part))
    for t in pq.read_table(f"{data}/documents.parquet")["text"].to_pylist():
        assert not seeds & fours(words(t or ""))


def test_one_word_and_short_names(spark):
    companies = spark.createDataFrame([("NVX", "Novartix AG"), ("QB", "Qb Group"), ("TWO", "Talmor Besk Mining AG"), (None, "Ghost"), ("NUL", None)], "ticker string, company string")
    listed = spark.createDataFrame([("NVX", "the novartix house"), ("TWO", None), (None, "novar")], "ticker string, alias string").select("alias", "ticker")
    texts = [(1, "Novartix", True), (2, "novartix ag", True), (3, "NVX", True), (4, "Shares of Novartix fall", False), (5, "qb", True), (6, "QB rises", False), (7, "Talmor Beskk Mining", True), (8, "the novartixx house", True), (9, "Novarelle", True), (10, "NUL", True), (11, None, True), (12, "", False)]
    got = {x.id: x.ticker for x in map_names(spark.createDataFrame(texts, "id long, text string, whole boolean"), companies, listed).collect()}
    assert got == {1: "NVX", 2: "NVX", 3: "NVX", 4: "NVX", 5: "QB", 6: "QB", 7: "TWO", 8: "NVX", 9: "NONE", 10: "NUL", 11: "NONE", 12: "NONE"}
