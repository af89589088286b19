import os

import duckdb
import pandas as pd
import pytest
from conftest import DATA

from palimpsest.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or x != x:
            return ""
        return f"{float(x):.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "if" else str(x).removesuffix(" 00:00:00")

    df = df[sorted(df.columns)]
    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_every_customer_is_a_release_point(spark, tmp_path):
    spark.range(900, 30_000, 100).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.sql("SELECT 7L AS o_orderkey, 3L AS o_custkey, DATE '1995-05-05' AS o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    assert QUERIES["timeline_summary_all"](spark, str(tmp_path)).groupBy().sum("release_points").first()[0] == 291
    assert QUERIES["plausible_dates_all"](spark, str(tmp_path)).count() == 292


def test_all_languages_orders_and_keys_take_part(spark, tmp_path):
    spark.createDataFrame([(1, "fr", "La LICENSE ici"), (2, None, "Été license"), (3, "en", "none")], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"]: r["snippet"] for r in QUERIES["search_snippet_all"](spark, str(tmp_path)).collect()} == {1: "La LICENSE ici", 2: "Été license", 3: "none"}
    orders = spark.range(1, 10_001).selectExpr("id AS o_orderkey", "7L AS o_custkey", "IF(id IN (10, 9000), 'F', 'O') AS o_orderstatus", "'1-URGENT' AS o_orderpriority", "date_add(DATE '1990-01-01', CAST(id AS INT)) AS o_orderdate")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    assert [r[0] for r in QUERIES["laws_page_all"](spark, str(tmp_path)).collect()] == list(range(9960, 9940, -1))
    assert [r[0] for r in QUERIES["last_derived_revision_all"](spark, str(tmp_path)).collect()] == [8999]
