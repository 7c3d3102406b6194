"""Registered queries read whole tables, and so does their SQL."""

import glob
import os
import re
from collections import Counter

import duckdb
import pytest

from veilspark.operators import evaluate as E
from veilspark.plans import catalog

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LAYOUT = ("q_line_offsets", "q_span_word_overlap", "q_line_pairs", "q_chains", "q_rect_merge", "q_near_label", "q_best_cover")


LARGER_TABLES = ("q_fuzzy_best", "q_leak_suspects", "q_token_bag_diff", "q_upper_median", "q_embedded_summary", "q_collapse")
#: Filters that queries once had.
SUBSETS = re.compile(r"(?:WHERE|AND) (?:doc_id % (?:5|10) |c_custkey <= 400|o_orderkey % [15]0 |text NOT LIKE '%ß%')")


def views(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.fixture(scope="module")
def duck():
    return views(SF)


def shown(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def same(spark, duck, name, sql, sf=SF):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    relation = duck.sql(sql)
    place = [relation.columns.index(c) for c in columns]
    assert Counter(tuple(shown(r[c]) for c in columns) for r in df.collect()) == Counter(tuple(shown(r[i]) for i in place) for r in relation.fetchall())


@pytest.mark.parametrize("name", LAYOUT)
def test_layout_of_all_documents(spark, duck, name):
    same(spark, duck, name, catalog.ORACLE_SQL[name])


def test_no_sql_keeps_a_subset():
    assert SUBSETS.search("FROM documents WHERE doc_id % 5 = 0") and not [n for n, sql in catalog.ORACLE_SQL.items() if SUBSETS.search(sql)]


def test_nms_reads_all_documents(spark, duck):
    files = {r.file for r in catalog.q_nms(spark, SF).select("file").distinct().collect()}
    assert files == {r[0] for r in duck.sql("SELECT doc_id FROM documents WHERE trim(replace(text, chr(10), ' ')) <> ''").fetchall()}


@pytest.mark.parametrize("name", LARGER_TABLES)
def test_whole_table(spark, name):
    same(spark, views(LARGER), name, catalog.ORACLE_SQL[name], LARGER)


def test_upper_medians(spark):
    inf, nan = float("inf"), float("nan")
    groups = {"a": [3.0, 1.0, 2.0], "b": [4.0, 1.0, 2.0, 3.0], "c": [5.0] * 4 + [-1e308, 1e308], "d": [inf, -inf, nan, 1.0, inf], "e": [None, 2.0, None, 1.0], "f": [None], None: [7.0, 9.0, 8.0], "g": [-inf, -inf, 0.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "key string, value double")
    assert {r.key: r["median"] for r in E.upper_medians(rows, 8).collect()} == {"a": 2.0, "b": 3.0, "c": 5.0, "d": inf, "e": 2.0, "f": None, None: 8.0, "g": -inf}
