"""Queries and their SQL on small tables of odd rows that the driver's smallest tables lack."""

import duckdb
import pytest

from readflow.plans import rules  # noqa: F401
from readflow.plans.queries import SQL, Q

PAGES = ["<title>A &amp B&&amp</title>", "<title>&notit; &eacute &#X41; &#128;</title>", "<title>&copy;&lt;&#0;&#55296;&#1114112; &zz; &;</title>", "<title>&amp;lt;</title>"]
TEXTS = ["EAST!!", "EAST WEST, a.\nÉAUX!!\tNORTH\tSOUTH;\tEND!\tON", "abc. DEF\n\nGHIJKL\t\"DR!\"\tX", "", None, "QUERY-LONG-LINE\nabcdef, ghi"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    pages = [(i, f"https://e.com/{i}", f"<html lang=en>{t}<body><article><p>{t[7:-8]} x</p></article></body></html>") for i, t in enumerate(PAGES)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["a16_paragraphs", "a16_parsed", "a22_articles", "c6_given_cuts", "d1_japanese_plan"])
def test_twin(spark, tables, name):
    found = Q[name](spark, tables)
    con = duckdb.connect()
    for table in ("pages", "documents"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet/*.parquet'")
    cols = ", ".join(f'"{c}"' for c in found.columns)
    want = con.sql(f"SELECT {cols} FROM ({SQL[name]})").fetchall()
    assert want and sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["c6_given_cuts", "d1_japanese_plan"])
def test_given_cuts_need_no_python(spark, tables, name):
    """Texts are cut in Spark's own memory, and shuffled once."""
    plan = Q[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") == 1
