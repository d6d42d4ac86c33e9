"""Copies of an article that share no run of figures in the same order."""

from tidemark.llm.dedup import ArticleStore

COLS = dict(id="news_id", url="url", title="title", body="body")
KIND = "news_id long, url string, title string, body string"

START = "Talks between the lenders and the board of the Galbel works went on after the summer break without any result and no vote was held on the sale of the northern yards"


def found(spark, path, rows, parts):
    store, out = ArticleStore(spark, str(path)), {}
    for ids in parts:
        got = store.ingest(spark.createDataFrame([r for r in rows if r[0] in ids], KIND), **COLS).collect()
        out |= {x.id: x.first for x in got}
    return out


def test_two_common_figures_apart(spark, tmp_path):
    rows = [
        (1, "https://a.example/1", "Lenders meet", "Profits rose 7 percent while 12 mills closed."),
        (2, "https://b.example/2", "Lenders meet", "Some 12 plants shut; 95 men left, and gains hit 7 points."),  # one title, other words and order
        (3, "https://c.example/3", "Lenders meet", "Some 13 plants shut; 95 men left, and gains hit 8 points."),  # figures of its own
        (4, "https://d.example/4", "Board split", f"{START}, which cost 41 crowns. Now 63 crews stay."),
        (5, "https://e.example/5", "No vote", f"{START}, as 63 people said. In 58 towns 41 shops shut."),  # the text, its figures apart
        (6, "https://f.example/6", "Other news", "Prices of 63 goods fell between 58 and 41 points."),  # figures alone are no link
    ]
    want = {2: 1, 5: 4}
    assert found(spark, tmp_path / "a", rows, [range(9)]) == want
    assert found(spark, tmp_path / "b", rows, [{1, 4}, {2, 3, 5, 6}]) == want
