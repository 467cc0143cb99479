"""Columns of the user that are named like an operator's own, in another case, and white space that only ASCII classes hold."""

import pytest

from larkspur.llm import decontam, packing, queries


def test_marks_replace_columns_in_any_case(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", 5, "x", 7)], "doc_id long, text string, Hits int, ITEMS string, N_Words int")
    items = spark.createDataFrame([(3, "a b c d e f g h i j")], "item_id long, text string")
    out = decontam.mark(docs, items)
    assert out.columns == ["doc_id", "text", "n_words", "hits", "items"]
    row = out.first()
    assert (row["n_words"], [tuple(h) for h in row["hits"]], row["items"]) == (11, [(0, 10)], ["3"])


def test_packing_replaces_columns_in_any_case(spark):
    docs = spark.createDataFrame([(1, "some words", 5, "x", 7, 1.0)], "doc_id long, TEXT string, Piece int, Sequence_ID string, OFFSET int, Length double")
    out = packing.pack_documents(docs)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() == 1


@pytest.mark.parametrize("name", ["op7_risk_controlled_rules", "op4_tensored_minhash", "op5_fingerprint_index", "op11_metric_space_join"])
def test_sql_knows_all_white_space(spark, tmp_path, name):
    import duckdb

    texts = [f"one\rtwo\x0cthree\x0bfour five {i} six\tseven eight nine ten eleven\n\x0c\none\rtwo\x0cthree" for i in range(40)] + ["a\rb\x0cc", "\x0b", "x\x1cy z"]
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(43)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())
