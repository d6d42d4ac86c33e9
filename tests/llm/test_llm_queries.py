"""The registered queries of the subpackage on the smallest tables."""

import __spark_entry__ as entry
from tidemark.llm import queries as Q


def test_registered():
    assert set(Q.QUERIES) <= set(entry.queries()) and set(Q.ORACLE) <= set(entry.oracle_sql())


def test_columns(spark, data):
    want = {"p4_found": ["news_id_a", "news_id_b"], "p5_found": ["news_id_a", "news_id_b"], "p6_found": ["rec_kind", "rec_id", "ticker"], "p7_found": ["news_id", "price_id"], "p8_found": ["doc_id", "item_id"]}
    for name, columns in want.items():
        df = Q.QUERIES[name](spark, data)
        assert df.columns == columns and df.count() >= 0, name
