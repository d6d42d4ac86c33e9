"""Keys of figures are made once for all slices, and a slice makes rows of its own keys alone."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import dedup
from tidemark.llm.dedup import ArticleStore, DedupLimits

COLS = dict(id="news_id", url="url", title="title", body="body")
KIND = "news_id long, url string, title string, body string"


def test_slices_hold_each_key_once(spark, tmp_path):
    rng = np.random.default_rng(5)
    counts = [0, 1, 2, 3, 5, 8]
    rows = [(i, f"https://a.example/{i}", "Title of all" if i > 3 else f"Other title {i}", "Some words " + " and ".join(str(x) for x in rng.choice(np.arange(3000, 9000), n, replace=False))) for i, n in enumerate(counts)]
    ArticleStore(spark, str(tmp_path)).ingest(spark.createDataFrame(rows, KIND), **COLS)
    name = next(p.name for p in tmp_path.iterdir() if p.name.startswith("features-"))
    feats = spark.read.schema(dedup._FEATURES).parquet(str(tmp_path / name)).withColumn("again", F.col("id") > 3)
    reps = dedup._marked(feats.withColumn("code", F.col("id") * 2 + 1), DedupLimits()).cache()
    slices = range(dedup._SLICES)
    got = {r.code // 2: (sum((r[f"keys{k}"] for k in slices), []), sum((r[f"keys{k}"][: r[f"small{k}"]] for k in slices), [])) for r in reps.collect()}
    for i, n in enumerate(counts):
        need = max(-(-6 * n // 10), 2)
        titled, few = n >= 2 and i > 3, n - need + 2
        every, first = got[i]
        assert len(set(every)) == len(every) == (n * (n - 1) // 2 + titled * n)
        assert len(first) == (few * (few - 1) // 2 + titled * (few - 1) if n >= 2 else 0)
        assert sum(x & 1 for x in every) == titled * n
    for k in slices:
        plan = dedup._figure_pairs(reps, DedupLimits(), k)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate explode") == 2 and "posexplode" not in plan and "Union" not in plan
    reps.unpersist()


def test_stars_read_their_rows_twice(spark):
    rows = spark.createDataFrame([(1, 7, False), (2, 7, True), (3, 8, False), (4, 8, False), (5, 9, True), (6, None, True), (7, 7, True)], "id long, page long, fresh boolean")
    stars = dedup._stars(rows, "page")
    assert sorted(map(tuple, stars.collect())) == [(1, 2), (1, 7)]  # no two old rows
    assert stars._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
