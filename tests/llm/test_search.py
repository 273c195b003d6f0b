import duckdb
import numpy as np

from quillon.llm import queries, topk
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def brute(rows, k):
    usable = [(i, [int(np.floor(256 * float(x))) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    usable = sorted((i, tuple(v)) for i, v in usable)
    out = []
    for q, v in sorted(set(usable)):
        if q % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op3_topk(spark, SF).collect())) == brute(rows, 5)


def test_ties_bad_rows_and_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", (7, 7))
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [0.5, -0.25]) for i in range(120)] + [(200, None), (None, [1.0, 1.0]), (250, [nan, 1.0]), (300, [inf, 0.0]), (350, [None, 1.0]), (400, []), (450, [9.0, 8.0]), (451, [9.0, 8.0]), (0, [0.5, -0.25])]
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], "vec_id long, embedding array<double>, query string, b int")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == brute(rows, 5)
    few = df.where("vec_id in (0, 1)")
    assert sorted(map(tuple, topk.top_k(few, F.col("vec_id") % 50 == 0).collect())) == brute([(0, [0.5, -0.25]), (1, [0.5, -0.25])], 5)
    assert topk.top_k(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_sql_equals_the_query_on_repeated_rows(spark):
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (0, [2.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [-3.0, 1.0]), (50, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    c = duckdb.connect()
    c.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    c.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    want = sorted(c.execute(queries.OP3_SQL).fetchall())
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect())) == want and len(want) == 13
