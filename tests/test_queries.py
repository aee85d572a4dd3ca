"""Every query with SQL against that SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def canonical(rows, names):
    def value(v):
        if isinstance(v, float):
            return round(v, 5) + 0.0
        return [value(x) for x in v] if isinstance(v, list | tuple) else v

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([value(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    want = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(want.fetchall(), names)


def test_recall_and_bounds_are_told(spark):
    q = entry.queries()
    told = q["ivf_recall"](spark, DATA).first()
    assert told["recall"] >= 0.9 and 0 < told["scored"] <= 1
    assert all(0 < r["scored"] <= r["corpus"] for r in q["sparse_rows_scored"](spark, DATA).collect())
    assert all(r["searched"] <= r["cells"] for r in q["bounded_cells"](spark, DATA).collect())


@pytest.mark.parametrize("name", ["fuzzy_label_map", "model_extract", "model_embed"])
def test_other_queries_give_a_row_for_each_document(spark, name):
    assert entry.queries()[name](spark, DATA).count() == 200


def test_entry(spark):
    assert entry.entry(spark).count() > 0
