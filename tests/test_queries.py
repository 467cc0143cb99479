import pytest

from larkspur.plans import offers, sources, sourcing

ALL = offers.QUERIES | sources.QUERIES | sourcing.QUERIES


@pytest.mark.parametrize("name", [k for k, (_, sql) in ALL.items() if sql])
def test_same_as_sql(same_as_sql, name):
    query, sql = ALL[name]
    same_as_sql(query, sql)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["wid", "rank", "orderkey", "linenumber", "suppkey", "quantity", "extended", "unit_price", "ref", "reasons"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark):
    from tests.conftest import SF

    plan = offers.retention(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan and "event_type:string>" in plan


def test_rows_without_sql(spark):
    from tests.conftest import SF

    for name in (k for k, (_, sql) in ALL.items() if not sql):
        assert ALL[name][0](spark, SF).count() > 0


def test_conditions_read_whole_texts(spark, tmp_path):
    far = "plain words " * 40
    texts = {3: far + "sold AS-IS", 4: far + "recertified", 8: far + "it was used once", 9: far, 5: far + "not working", 6: far + "broken", 7: far, 13: None, 10: None, 14: "x" * 200_000 + " pre-owned"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["condition"] for r in offers.conditions(spark, str(tmp_path)).collect()}
    assert got == {3: "parts", 4: "refurbished", 8: "used", 9: "new", 5: "parts", 6: "parts", 7: "parts", 13: "new", 10: "used", 14: "used"}


def test_missing_words_read_all_titles(spark, tmp_path):
    parts = [(1, "green bolt", "LARGE BRUSHED TIN"), (501, "large nut", "SMALL PLATED TIN"), (7, "red cap", "TIN CAP")]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    assert {r["wid"]: r["missing"] for r in offers.words_missing(spark, str(tmp_path)).collect()} == {1: "brushed plated small tin", 7: "tin"}


def test_upsert_takes_all_new_rows(spark, tmp_path):
    orders = [(1, "1-URGENT", 5.0), (1, "2-HIGH", 7.0), (2, "1-URGENT", 2.0), (2, "3-MEDIUM", 1.0), (3, "1-URGENT", 4.0), (3, "1-URGENT", 4.0)]
    spark.createDataFrame(orders, "o_custkey long, o_orderpriority string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(tuple(r) for r in offers.upsert(spark, str(tmp_path)).collect())
    assert got == [(1, "1-URGENT", 1, 5.0), (1, "2-HIGH", 1, 7.0), (2, "1-URGENT", 1, 2.0), (2, "3-MEDIUM", 1, 1.0), (3, "1-URGENT", 2, 8.0)]


def test_all_items_have_history(spark, tmp_path):
    parts = [(i, 10.0 * i) for i in range(1, 8)]
    spark.createDataFrame(parts, "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(tuple(r) for r in offers._history(spark, str(tmp_path)).collect()) == [(i, p, p + 1) for i, p in parts]
