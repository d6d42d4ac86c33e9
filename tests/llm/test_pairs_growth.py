"""Bodies that share figures or a phrase, but not their text, are not paired: their pairs grow with the square of the bodies."""

import numpy as np

from tidemark.llm import dedup
from tidemark.llm.dedup import ArticleStore

COLS = dict(id="news_id", url="url", title="title", body="body")
KIND = "news_id long, url string, title string, body string"


def paired(spark, path, monkeypatch, bodies):
    """Result of one delivery, and the most pairs (a, b) that any step kept."""
    most, real = [0], dedup.cut

    def counted(df):
        out = real(df)
        if out.columns == ["a", "b"]:
            most[0] = max(most[0], out.count())
        return out

    monkeypatch.setattr(dedup, "cut", counted)
    rows = [(i, f"https://a.example/{i}", f"Title number {i} of all", b) for i, b in enumerate(bodies)]
    got = ArticleStore(spark, str(path)).ingest(spark.createDataFrame(rows, KIND), **COLS).collect()
    return {x.id: x.first for x in got if x.id != x.first}, most[0]


def text(rng, n=40):
    return ["".join(rng.choice(list("abcdefghiklmnoprstu"), 7)) for _ in range(n)]


def test_same_figures_other_words(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    words = [text(rng) for _ in range(60)]
    bodies = [" ".join([*w[:10], "41", *w[10:20], "58", *w[20:30], "63", *w[30:]]) for w in words]
    bodies.append(" ".join(["63", *words[7][:20], "58", "41", *words[7][20:]]))  # the figures elsewhere in the text
    links, most = paired(spark, tmp_path, monkeypatch, bodies)
    assert links == {60: 7}
    assert most < 300  # of 1,830


def test_same_phrase_other_words(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    phrases = [text(rng, 16) for _ in range(2)]
    bodies = [" ".join([*phrases[i % 2], *text(rng, 30)]) for i in range(60)]  # a third of each body, and less than the part it may lack
    bodies.append(" ".join(bodies[9].split()[:40]))
    links, most = paired(spark, tmp_path, monkeypatch, bodies)
    assert links == {60: 9}
    assert most < 100
