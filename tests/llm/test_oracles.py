"""The SQL of the operators against their queries, on tables that hold odd rows."""

import duckdb
import numpy as np
import pytest

from helmwind.llm import queries


def both(spark, folder, table, name):
    """Rows of the SQL and of the query, as sorted lists, after a check of the columns."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    asked = con.execute(queries.ORACLE_SQL[name])
    columns, want = [c[0] for c in asked.description], asked.fetchall()
    got = queries.QUERIES[name](spark, str(folder))
    assert got.columns == columns
    return sorted(want, key=repr), sorted((tuple(r) for r in got.collect()), key=repr)


def test_substring_sql(spark, odd, tmp_path):
    odd.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want, got = both(spark, tmp_path, "documents", "op6_substring_dedup")
    assert got == want
    assert {r[0] for r in got if r[2]} >= {6, 7, 8, 11, 13}


def test_embedding_sql(spark, tmp_path):
    rng = np.random.default_rng(5)
    first = rng.normal(size=(40, 16))
    close = np.concatenate([first, first[:20] + rng.normal(scale=0.05, size=(20, 16)), first[:5]])
    rows = [(i, x.tolist(), "ab"[i % 20 % 2]) for i, x in enumerate(close)]
    plain = first[0].tolist()
    odd = [None, [], [0.0] * 16, [float("nan"), *plain[1:]], [None, *plain[1:]], [float("inf"), *plain[1:]], plain[:8]]
    rows += [(100 + i, x, "a") for i, x in enumerate(odd)] + [(200, plain, None), (201, plain, "c")]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    want, got = both(spark, tmp_path, "embeddings", "op10_embedding_near_dedup")
    assert got == want
    assert sum(r[1] for r in got) > 30


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_belongs_to_a_query(name):
    assert name in queries.QUERIES
