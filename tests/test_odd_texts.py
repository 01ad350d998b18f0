"""Queries over tables in which some texts are empty or null give the rows of their SQL; a missing vocabulary is an error."""

import os

import pyarrow as pa
import pytest
from tests.test_core import RANKS

import __spark_entry__ as entry
from tokloom import catalog, encoding
from tokloom.encoding import toy
from tokloom.functions import table
from tokloom.plans import corpus

has_vocabulary = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary file")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    rows = [(1, "The cat, the dogs."), (2, ""), (3, None), (4, " "), (5, "naïve 12345 \n\n日本語"), (6, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def same_as_sql(spark, folder, name):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = c.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, folder)
    assert sorted(map(repr, map(tuple, df.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


@has_vocabulary
def test_bpe_encode_of_empty_texts(spark, odd):
    same_as_sql(spark, odd, "bpe_encode")


@has_vocabulary
def test_bpe_count_of_empty_texts(spark, odd):
    same_as_sql(spark, odd, "bpe_count")


@has_vocabulary
def test_decode_by_join_of_empty_texts(spark, odd):
    same_as_sql(spark, odd, "decode_by_join")


@has_vocabulary
def test_stream_count_of_empty_texts(spark, odd):
    same_as_sql(spark, odd, "stream_count")


def test_a_missing_vocabulary_is_an_error(spark, odd, monkeypatch):
    import duckdb

    monkeypatch.setattr(catalog, "RANKS", "/no/such/file.tiktoken")
    catalog.vocabulary.cache_clear()
    catalog._packed.cache_clear()
    try:
        with pytest.raises(FileNotFoundError):
            entry.queries()["bpe_count"](spark, odd)
        c = duckdb.connect()
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
        for name in ("bpe_count", "blob_round_trip"):
            with pytest.raises(duckdb.Error):
                c.sql(entry.oracle_sql()[name]).fetchall()
    finally:
        catalog.vocabulary.cache_clear()
        catalog._packed.cache_clear()


def test_the_set_plan_shuffles_runs_of_ids(spark, monkeypatch):
    rows = [(k, "the cat the dog\n" * (1 + 400 * (k % 2)) + "zebra" * (k % 3) + " end") for k in range(40)] + [(100, ""), (101, None), (None, "null key")]
    df = spark.createDataFrame(rows, "key long, text string")
    monkeypatch.setattr(corpus, "FREQUENT", 6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)  # texts and keys go over the ends of batches
    try:
        for keys in (["key"], ["key", "other"], ["both"]):
            wide = df.selectExpr("key", "CAST(key % 2 AS STRING) AS other", "struct(key, 1 AS one) AS both", "text")
            made = corpus.encode_set(wide, "text", toy(), *keys)
            assert "Window" not in made._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(repr, made.collect())) == sorted(map(repr, corpus.token_rows(wide, "text", toy(), *keys).collect()))
        assert corpus.set_runs(df, "text", toy(), "key").count() < corpus.token_rows(df, "text", toy(), "key").count() / 4
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_differences_of_lists(spark):
    runs = spark.createDataFrame([(1, 2, [7, 8]), (1, 0, [5, 6]), (2, 0, [1]), (4, 0, [3])], "key int, first int, ids array<int>")
    lists = spark.createDataFrame([(1, [5, 6, 7, 8]), (2, [1, 2]), (3, [9, 9]), (5, []), (6, None)], "key int, ids array<int>")
    got = {r["key"]: (r["n_different"], r["n_tokens"]) for r in corpus.list_differences(runs, lists, ["key"]).collect()}
    assert got == {1: (0, 4), 2: (1, 2), 3: (2, 2), 4: (1, 0), 5: (0, 0), 6: (0, 0)}


@has_vocabulary
def test_plans_agree_joins_no_tokens(spark, odd):
    same_as_sql(spark, odd, "plans_agree")
    plan = entry.queries()["plans_agree"](spark, odd)._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan and "Window" not in plan


def test_table_function_of_places_and_ids(spark, odd):
    table.register_tokens(spark, toy(), "t_odd")
    spark.createDataFrame([(1, "abcé"), (2, ""), (3, None), (4, "x" * 3_000_000 + " abc")], "key int, text string").createOrReplaceTempView("t_texts")
    every, few = ("SELECT key, count(*) AS n, sum(CAST(t.pos AS BIGINT) * t.id) AS s FROM t_texts, LATERAL {}(text) t GROUP BY key".format(f) for f in ("t_odd", "t_odd_ids"))
    assert sorted(map(tuple, spark.sql(few).collect())) == sorted(map(tuple, spark.sql(every).collect()))
    same_as_sql(spark, odd, "sql_table_function")
    plan = entry.queries()["sql_table_function"](spark, odd)._jdf.queryExecution().executedPlan().toString()
    assert "UDTF" not in plan and "Join" not in plan and "ArrowEvalPython" in plan


def test_columns_are_encoded_by_slices(monkeypatch):
    e = encoding.Encoding("chat", [(bytes([b]), b) for b in range(256)], [(b"<|end|>", 256)])
    texts = ["abc", None, "", "é<|end|>x", "long " * 50, None, "", "z<|end|>"] * 9
    for size in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(encoding, "SLICE", size)
        for column in (pa.array(texts, pa.string()), pa.array(texts, pa.string())[3:40], pa.array([], pa.string()), pa.array([None], pa.string())):
            seen = []
            special = lambda c: seen.append(len("".join(x or "" for x in c.to_pylist()).encode()) if len(c) > 1 else 0) or e.encode_special_column(c)[0]  # noqa: B023, E731
            assert encoding.sliced(column, e.encode_column).to_pylist() == e.encode_column(column).to_pylist()
            assert encoding.sliced(column, e.count_column).to_pylist() == e.count_column(column).to_pylist()
            assert encoding.sliced(column, special).to_pylist() == e.encode_special_column(column)[0].to_pylist()
            assert max(seen) <= size
