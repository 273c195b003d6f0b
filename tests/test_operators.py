import pytest
from pyspark.sql import functions as F

from quillon.functions.logic import quotient
from quillon.functions.text import split_list, words
from quillon.operators import rows
from quillon.plans.stats import catalog_stats, table_size
from quillon.sources import logs
from quillon.sources.tables import NoSuchTable, TableExists, Tables, WriteConflict
from quillon.streaming import tail


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(1, 10), (2, None), (3, 0)], "id int, v int")


def test_three_valued_logic(nulls):
    assert values(rows.project(nulls, ["id"], ~(F.col("v") > 5))) == [(3,)]
    assert values(rows.delete(nulls, F.col("v") > 5)) == [(2, None), (3, 0)]
    assert values(rows.update(nulls, {"v": F.lit(7)}, F.col("v") > 5)) == [(1, 7), (2, None), (3, 0)]
    assert values(rows.update(nulls, {"v": F.lit(7)})) == [(1, 7), (2, 7), (3, 7)]
    assert rows.delete(nulls).count() == 0
    assert values(nulls.select(quotient(F.lit(1), F.col("v")))) == [(0.1,), (None,), (None,)]


def test_append_checks_arity(spark, nulls):
    one = spark.createDataFrame([(9,)], "x int")
    assert values(rows.append(nulls, one, ["v"]))[-1] == (None, 9)
    with pytest.raises(rows.ArityError):
        rows.append(nulls, one)


def test_positions(spark):
    t = spark.createDataFrame([(f"r{i}", i) for i in range(4)], "a string, k int")
    assert values(rows.with_positions(t, ["k"])) == [("r0", 0, 0), ("r1", 1, 1), ("r2", 2, 2), ("r3", 3, 3)]
    less = rows.delete_at(t, ["k"], 1)
    assert values(rows.update_at(less, ["k"], 1, {"a": F.lit("new")})) == [("new", 2), ("r0", 0), ("r3", 3)]
    assert rows.delete_at(t, ["k"], 4).count() == 4 and values(rows.update_at(t, ["k"], 9, {"a": F.lit("x")})) == values(t)


def test_positions_of_any_place_name_and_null_key(spark):
    t = spark.createDataFrame([(i if i else None, f"r{i}", 7, 8) for i in range(50)], "k int, a string, part int, position int")
    got = rows.with_positions(t, ["k"])
    assert got.columns == ["k", "a", "part", "position"] and {(r.a, r.position) for r in got.collect()} == {(f"r{i}", i) for i in range(50)}
    assert rows.row_at(t, ["k"], 49).first().a == "r49" and rows.row_at(t, ["k"], 50).count() == 0
    assert "r0" not in {r.a for r in rows.delete_at(t, ["k"], 0).collect()}
    assert values(rows.update_at(t, ["k"], 0, {"a": F.lit("x")}).where("a = 'x'")) == [(None, "x", 7, 8)]


def test_joins_with_null_keys(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    b = spark.createDataFrame([(2, "x"), (None, "y"), (3, "z")], "j int, w string")
    n = {how: rows.join(a, b, {"k": "j"}, how).count() for how in ("inner", "left", "right", "full", "left_semi", "left_anti")}
    assert n == {"inner": 1, "left": 3, "right": 3, "full": 5, "left_semi": 1, "left_anti": 2}
    assert values(rows.join(a, b, {"k": "j"}, null_safe=True)) == [(2, "b", 2, "x"), (None, "c", None, "y")]
    with pytest.raises(ValueError):
        rows.join(a, b, {"k": "j"}, "cross")


def test_groups_top_rows_and_json(spark):
    t = spark.createDataFrame([(1, 5), (1, 7), (None, 3)], "g int, v int")
    assert values(rows.aggregate(t, ["g"], {"n": F.count("*"), "s": F.sum("v")})) == [(1, 2, 12), (None, 1, 3)]
    assert values(rows.aggregate(t, [], {"n": F.count("*")}, F.col("n") > 9)) == []
    assert values(rows.top(t, ["g"], [F.desc("v")], 1)) == [(1, 7), (None, 3)]
    docs = spark.createDataFrame([('{"v": 1, "x": 2}',), ('{"g": 4, "v": 2}',), ("{oops",), (None,)], "doc string")
    more, wrong = rows.append_json(t, docs, "doc")
    assert values(more)[-2:] == [(None, 1), (None, 3)] and more.count() == 5 and values(wrong) == [("{oops",), (None,)]


def test_a_failed_write_blocks_nothing(spark, tmp_path, monkeypatch):
    t = Tables(spark, f"{tmp_path}/tables")
    t.create("x", "id int")
    bad = spark.range(4).select(F.raise_error(F.lit("stop")).cast("int").alias("id"))
    with pytest.raises(Exception, match="stop"):
        t.write("x", bad)
    (tmp_path / "tables/x/version=1").mkdir()  # what a writer of another kind left
    one = spark.createDataFrame([(1,)], "id int")
    assert t.write("x", one) == 2 and values(t.read("x")) == [(1,)] and t.names() == ["x"]
    monkeypatch.setattr(t, "_names", lambda path, f=t._names: [n for n in f(path) if n != "version=2"])  # one that has not seen the last version
    with pytest.raises(WriteConflict):
        t.write("x", one)


def test_files_are_merged_and_counted(spark, tmp_path):
    t = Tables(spark, f"{tmp_path}/tables")
    t.write("x", spark.range(100).repartition(8))
    t.merge_files("x")
    assert len(list((tmp_path / "tables/x/version=1").glob("*.parquet"))) == 1 and t.read("x").count() == 100
    got = t.totals(catalog_stats).first()
    assert (got.table_count, got.total_records, got.total_size, got.index_count) == (1, 100, 192, 0) and got.disk_usage == t.disk_usage() > 0
    t.backup("x", f"{tmp_path}/copy")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        t.backup("x", f"{tmp_path}/copy")


def test_versioned_tables(spark, tmp_path):
    t = Tables(spark, f"{tmp_path}/tables")
    t.create("users", ["id", "name"])
    with pytest.raises(TableExists):
        t.create("users", "id int")
    t.write("users", rows.append(t.read("users"), spark.createDataFrame([("1", "admin")], "a string, b string")))
    t.write("users", rows.update(t.read("users"), {"name": F.lit("x")}))
    assert [values(t.read("users", v)) for v in (0, 1, 2)] == [[], [("1", "admin")], [("1", "x")]]
    t.backup("users", f"{tmp_path}/copy")
    t.write("users", rows.delete(t.read("users")))
    t.restore("users", f"{tmp_path}/copy")
    assert values(t.read("users")) == [("1", "x")] and values(t.list_tables()) == [("users",)]
    assert values(t.describe("users")) == [(0, "id", "string"), (1, "name", "string")]
    t.retain("users", 2)
    assert t.versions("users") == [3, 4]
    with pytest.raises(NoSuchTable):
        t.read("Users")
    t.drop("users")
    with pytest.raises(NoSuchTable):
        t.drop("users")


def test_size_counts_bytes(spark):
    df = spark.createDataFrame([("é",), ("日本",), (None,)], "s string")
    assert values(table_size(df)) == [(3, 9)] and values(table_size(df.limit(0))) == [(0, 0)]


def test_log_replay_and_dialect(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.log").write_text("CREATE TABLE users (id, name)\nINSERT INTO users VALUES (1, admin)\n\nINSERT INTO nobody VALUES (1)\nDROP TABLE users\nINSERT INTO users VALUES (2, , bob);\nINSERT INTO users VALUES (3, 'x', y)\n")
    got = logs.replayed(logs.lines(spark, f"{tmp_path}/log"))
    assert [(r.target, r.line_no, r["items"]) for r in got.orderBy("line_no").collect()] == [("users", 1, ["1", "admin"]), ("users", 5, ["2", "bob"])]
    q = tail.follow(spark, f"{tmp_path}/log", f"{tmp_path}/state", "verbs_seen")
    q.awaitTermination(60)
    assert values(spark.table("verbs_seen")) == [("CREATE", 1), ("DROP", 1), ("INSERT", 4)]


def test_words_and_lists(spark):
    df = spark.createDataFrame([(" a\x0bb\u00a0c\n",), ("",)], "s string")
    assert values(df.select(words(F.col("s")).alias("w"))) == [(["a", "b\u00a0c"],), ([],)]
    assert df.select(split_list(F.lit(" a, ,\t'b' ,c\n"))).first()[0] == ["a", "'b'", "c"]
