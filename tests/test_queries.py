"""Registered queries over small tables of their own."""

from datetime import datetime

import duckdb

import __spark_entry__ as entry


def tables(spark, path, **frames):
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"file://{path}/{name}.parquet")
    return f"file://{path}"


def test_tfidf_scores_every_document(spark, tmp_path):
    good, bad = "a calm and pleasant stay by the sea", "spam spam buy now cheap pills"
    docs = [(i, good if i % 2 else bad) for i in range(40)] + [(100, good), (101, bad), (102, None), (103, ""), (None, good)]
    labels = [(i, i % 2) for i in range(30)] + [(30, None), (999, 1)]
    sf = tables(spark, tmp_path, documents=(docs, "doc_id long, text string"), labels=(labels, "doc_id long, quality int"))
    got = {r["doc_id"]: r for r in entry.queries()["tfidf_scores"](spark, sf).collect()}
    assert set(got) == {i for i, _ in docs}
    assert all(got[i]["predicted"] == (t == good) for i, t in docs if t)
    assert all(0 <= r["score"] <= 1 for r in got.values())


LINES = "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"


def both(spark, path, name, lines, orders, customers):
    """The rows of a query and those of its SQL in DuckDB, over lines, orders and customers."""
    at = [(*r[:4], r[4] and datetime(2024, 1, r[4])) for r in lines]
    sf = tables(spark, path, lineitem=(at, LINES), orders=([(*o, "F", "1") for o in orders], ORDERS), customer=(customers, "c_custkey long, c_nationkey int"))
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet/*.parquet')")
    key = lambda r: tuple(map(str, r))
    return sorted(map(tuple, entry.queries()[name](spark, sf).collect()), key=key), sorted(con.execute(entry.oracle_sql()[name]).fetchall(), key=key)


def test_cards_are_those_of_the_sql(spark, tmp_path):
    """Lines without a date or number come last, orders without a customer and with two, and an order given twice."""
    lines = [(1, 1, "A", "F", None), (1, 2, "N", "O", 3), (2, None, "A", "F", 1), (2, 2, "N", "O", 1), (3, 2, "A", "F", None), (3, 1, "N", "O", None), (4, 1, "N", "O", 1), (5, 1, "N", "O", 1), (6, 1, "N", "O", 1), (7, 1, "N", None, 1), (7, 2, "N", "O", 2), (None, 1, "N", "O", 1)]
    orders = [(1, 1), (2, 1), (3, 1), (4, 9), (5, 2), (6, 1), (6, 1), (7, None), (8, 1), (None, 1)]
    got, want = both(spark, tmp_path, "finding_cards", lines, orders, [(1, 1), (2, 1), (2, 2)])
    assert got == want and len(got) == len(orders)
    assert {r[0] for r in got if r[1]} == {1, 2, 3, 4, 5, 6}


def test_decisions_are_those_of_the_sql(spark, tmp_path):
    """A line without a flag is rejected, but conflicts with nothing."""
    lines = [(1, 1, "N", "O", 1), (1, 2, None, "F", 2), (2, 1, None, "O", 1), (2, 2, "N", "O", 2), (3, 1, None, "O", 1), (3, 2, "A", "O", 2), (4, 1, None, "O", 1), (5, 1, None, "O", 1), (5, 2, "N", "O", 2), (5, 3, "R", "O", 3), (6, 1, "N", "O", None), (6, 2, "A", "O", 2)]
    got, want = both(spark, tmp_path, "finding_decisions", lines, [(k, 1) for k in range(1, 8)], [(1, 1)])
    assert got == want
    assert [r[1] for r in got] == ["confirmed", *["rejected"] * 5, "proposed"]
    assert [r[0] for r in got if r[2]] == [5, 6]
