"""The registered queries of the table operators, each over whole given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.logic import quotient, typed_compare
from quillon.functions.text import cell, first_word_upper, split_list, words
from quillon.operators import rows
from quillon.plans.stats import catalog_stats, files_needed

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
_CORE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def query(sql: str | None = None):
    def put(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return put


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT * FROM nation")
def scan_all(spark, sf_dir):
    return rows.project(_read(spark, sf_dir, "nation"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def project_columns(spark, sf_dir):
    return rows.project(_read(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def flagship(spark, sf_dir):
    return rows.project(_read(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"], (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity <= 10 OR l_returnflag <> 'N') AND NOT l_linestatus = 'O'")
def filter_compound(spark, sf_dir):
    where = ((F.col("l_quantity") <= 10) | (F.col("l_returnflag") != "N")) & ~(F.col("l_linestatus") == "O")
    return rows.project(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"], where)


def _comparison(name: str, sign: str, apply) -> None:
    def run(spark, sf_dir):
        return rows.project(_read(spark, sf_dir, "part"), ["p_partkey", "p_size"], apply(F.col("p_size"), F.lit(25)))

    run.__name__ = f"compare_{name}"
    query(f"SELECT p_partkey, p_size FROM part WHERE p_size {sign} 25")(run)


for _name, _sign, _apply in [
    ("eq", "=", Column.__eq__),
    ("ne", "<>", Column.__ne__),
    ("lt", "<", Column.__lt__),
    ("le", "<=", Column.__le__),
    ("gt", ">", Column.__gt__),
    ("ge", ">=", Column.__ge__),
]:
    _comparison(_name, _sign, _apply)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def logic_and(spark, sf_dir):
    return _read(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'")
def logic_or(spark, sf_dir):
    return _read(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") | (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")


@query("SELECT o_orderkey, -o_totalprice AS negated FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 50000)")
def logic_not_unary(spark, sf_dir):
    return _read(spark, sf_dir, "orders").where(~((F.col("o_orderstatus") == "F") | (F.col("o_totalprice") < 50000))).select("o_orderkey", (-F.col("o_totalprice")).alias("negated"))


@query("SELECT l_orderkey, l_linenumber + 5 AS plus, l_linenumber - 5 AS minus, l_linenumber * 3 AS times, l_linenumber / 4 AS quotient, l_linenumber / NULLIF(l_linenumber - 1, 0) AS safe, 2 + l_linenumber * 3 - 1 AS precedence FROM lineitem")
def arithmetic(spark, sf_dir):
    n = F.col("l_linenumber")
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", (n + 5).alias("plus"), (n - 5).alias("minus"), (n * 3).alias("times"), (n / 4).alias("quotient"), quotient(n, n - 1).alias("safe"), (2 + n * 3 - 1).alias("precedence"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS v, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END > 100000 AS known FROM orders WHERE NOT (CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END > 100000)")
def null_logic(spark, sf_dir):
    value, wider = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return _read(spark, sf_dir, "orders").where(~(wider > 100000)).select("o_orderkey", value.alias("v"), (value > 100000).alias("known"))


@query("SELECT o_orderkey, CAST(7 AS BIGINT) AS i, 'it''s' AS s, CAST(NULL AS VARCHAR) AS n FROM orders")
def literals(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.lit(7).cast("long").alias("i"), F.lit("it's").alias("s"), F.lit(None).cast("string").alias("n"))


@query("SELECT c_custkey FROM customer WHERE TRY_CAST(c_name AS DOUBLE) = 1 OR TRY_CAST(CAST(c_nationkey AS VARCHAR) AS DOUBLE) = 3")
def untyped_compare(spark, sf_dir):
    return _read(spark, sf_dir, "customer").where(typed_compare(F.col("c_name"), F.lit(1)) | typed_compare(F.col("c_nationkey").cast("string"), F.lit(3))).select("c_custkey")


@query("SELECT * FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, 'SUPPLIER' FROM supplier")
def insert_append(spark, sf_dir):
    new = _read(spark, sf_dir, "supplier").withColumn("segment", F.lit("SUPPLIER"))
    return rows.append(_read(spark, sf_dir, "customer"), new)


@query("SELECT * FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, NULL, NULL FROM supplier")
def insert_column_list(spark, sf_dir):
    return rows.append(_read(spark, sf_dir, "customer"), _read(spark, sf_dir, "supplier").select("s_name", "s_suppkey"), ["c_name", "c_custkey"])


@query("SELECT event_id, event_type, props, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def insert_json(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", "event_type", "props", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 100000 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders")
def update_where(spark, sf_dir):
    return rows.update(_read(spark, sf_dir, "orders"), {"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") * 2}, F.col("o_totalprice") > 100000)


@query("SELECT * FROM orders WHERE NOT coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END > 100000, false)")
def delete_where(spark, sf_dir):
    return rows.delete(_read(spark, sf_dir, "orders"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")) > 100000)


@query("SELECT * FROM orders WHERE false")
def delete_all(spark, sf_dir):
    return rows.delete(_read(spark, sf_dir, "orders"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders")
def row_position(spark, sf_dir):
    return rows.with_positions(_read(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query("SELECT * EXCLUDE (p) FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE p <> 7")
def delete_row_id(spark, sf_dir):
    return rows.delete_at(_read(spark, sf_dir, "orders"), ["o_orderkey"], 7)


@query("SELECT * EXCLUDE (p) REPLACE (CASE WHEN p = 7 THEN 'X' ELSE o_orderstatus END AS o_orderstatus) FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders)")
def update_row_id(spark, sf_dir):
    return rows.update_at(_read(spark, sf_dir, "orders"), ["o_orderkey"], 7, {"o_orderstatus": F.lit("X")})


def _stat_sql() -> str:
    columns = {
        "region": "r_regionkey r_name",
        "nation": "n_nationkey n_name n_regionkey",
        "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
        "supplier": "s_suppkey s_name s_nationkey s_acctbal",
        "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    }
    parts = []
    for name, listed in columns.items():
        cells = " + ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)), 0)" for c in listed.split())
        parts.append(f"SELECT '{name}' AS name, count(*) AS n_rows, CASE WHEN count(*) > 0 THEN CAST(sum({cells}) + {len(listed.replace(' ', ''))} AS BIGINT) ELSE 0 END AS size_bytes, CAST(0 AS BIGINT) AS index_count FROM {name}")
    return " UNION ALL ".join(parts)


@query(_stat_sql())
def table_stats(spark, sf_dir):
    return catalog_stats({n: _read(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "orders")})


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows FROM {n}" for n in _CORE))
def table_counts(spark, sf_dir):
    out = None
    for name in _CORE:
        one = _read(spark, sf_dir, name).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT c_custkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, CAST(c_nationkey AS VARCHAR) AS c_nationkey, coalesce(CASE WHEN c_nationkey <> 3 THEN c_name END, 'NULL') AS c_name FROM customer")
def cell_to_string(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select("c_custkey", cell(F.col("c_acctbal")).alias("c_acctbal"), cell(F.col("c_nationkey")).alias("c_nationkey"), cell(F.when(F.col("c_nationkey") != 3, F.col("c_name"))).alias("c_name"))


@query("SELECT p_partkey, p_partkey || ' | ' || p_name || ' | ' || p_size || ' | ' AS line FROM part")
def text_rows(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", F.concat(F.concat_ws(" | ", F.col("p_partkey").cast("string"), "p_name", F.col("p_size").cast("string")), F.lit(" | ")).alias("line"))


@query("SELECT p_partkey, '[\"' || p_name || '\",\"' || p_size || '\"]' AS json FROM part")
def json_rows(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", F.to_json(F.array("p_name", F.col("p_size").cast("string"))).alias("json"))


@query("SELECT p_partkey, CAST(len(w) AS INTEGER) AS n, array_to_string(w, '/') AS items, upper(split_part(p_name, ' ', 1)) AS verb FROM (SELECT *, list_filter(list_transform(string_split(p_name || ' , ,x', 'e'), lambda x: trim(x)), lambda x: x <> '') AS w FROM part)")
def split_items(spark, sf_dir):
    items = split_list(F.concat("p_name", F.lit(" , ,x")), "e")
    return _read(spark, sf_dir, "part").select("p_partkey", F.size(items).alias("n"), F.concat_ws("/", items).alias("items"), first_word_upper(F.col("p_name")).alias("verb"))


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(props, event_id) AS props, count(*) AS n FROM events GROUP BY user_id, event_type")
def log_replay(spark, sf_dir):
    """The state that replaying the events leaves: the last one of each user and type."""
    return rows.aggregate(_read(spark, sf_dir, "events"), ["user_id", "event_type"], {"event_id": F.max("event_id"), "props": F.max_by("props", "event_id"), "n": F.count("*")})


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type HAVING count(*) > 1")
def command_answers(spark, sf_dir):
    """What was asked for, how often and by how many."""
    return rows.aggregate(_read(spark, sf_dir, "events"), ["event_type"], {"n": F.count("*"), "n_users": F.countDistinct("user_id")}, F.col("n") > 1)


@query(r"SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n_words, CAST(sum(len(list_distinct(w))) AS BIGINT) AS n_distinct FROM (SELECT lang, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents) GROUP BY lang")
def tokenize(spark, sf_dir):
    """Words of whole texts, and different ones by document, summed by language."""
    found = _read(spark, sf_dir, "documents").select("lang", words(F.coalesce("text", F.lit(""))).alias("w"))
    return rows.aggregate(found, ["lang"], {"n_words": F.sum(F.size("w")).cast("long"), "n_distinct": F.sum(F.size(F.array_distinct("w"))).cast("long")})


@query("SELECT source, count(*) AS n_docs, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS n_bytes, count(DISTINCT sha256(coalesce(text, ''))) AS n_different, min(sha256(coalesce(text, ''))) AS least FROM documents GROUP BY source")
def page_verify(spark, sf_dir):
    """Checksums of whole texts: how many differ, by source."""
    text = F.coalesce("text", F.lit(""))
    summed = _read(spark, sf_dir, "documents").select("source", F.octet_length(text).alias("n"), F.sha2(text.cast("binary"), 256).alias("digest"))
    return rows.aggregate(summed, ["source"], {"n_docs": F.count("*"), "n_bytes": F.sum("n").cast("long"), "n_different": F.countDistinct("digest"), "least": F.min("digest")})


@query("SELECT source, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS n_bytes, CAST(greatest(1, ceil(sum(strlen(coalesce(text, ''))) / 65536.0)) AS BIGINT) AS n_files FROM documents GROUP BY source")
def compaction_trigger(spark, sf_dir):
    """How many files of 64 KB the documents of each source need, once merged."""
    sizes = _read(spark, sf_dir, "documents").select("source", F.octet_length(F.coalesce("text", F.lit(""))).alias("n"))
    return rows.aggregate(sizes, ["source"], {"n_bytes": F.sum("n").cast("long"), "n_files": files_needed(F.sum("n"), 65536)})


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def inner_join(spark, sf_dir):
    c = rows.project(_read(spark, sf_dir, "customer"), where=F.col("c_mktsegment") == "BUILDING")
    return rows.join(c, _read(spark, sf_dir, "orders"), {"c_custkey": "o_custkey"}).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


def _sided(how: str, sql: str, columns: list[str]) -> None:
    def run(spark, sf_dir):
        left = _read(spark, sf_dir, "customer").select(F.when(F.col("c_nationkey") != 3, F.col("c_custkey")).alias("key"), "c_name")
        return rows.join(left, _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), {"key": "o_custkey"}, how).select(*columns)

    run.__name__ = f"{how}_join"
    query(sql)(run)


_LEFT = "(SELECT CASE WHEN c_nationkey <> 3 THEN c_custkey END AS key, c_name FROM customer) c"
_sided("left", f"SELECT key, c_name, o_orderkey FROM {_LEFT} LEFT JOIN orders ON key = o_custkey", ["key", "c_name", "o_orderkey"])
_sided("full", f"SELECT key, c_name, o_orderkey FROM {_LEFT} FULL JOIN orders ON key = o_custkey", ["key", "c_name", "o_orderkey"])
_sided("left_semi", f"SELECT key, c_name FROM {_LEFT} WHERE EXISTS (FROM orders WHERE o_custkey = key)", ["key", "c_name"])
_sided("left_anti", f"SELECT key, c_name FROM {_LEFT} WHERE NOT EXISTS (FROM orders WHERE o_custkey = key)", ["key", "c_name"])


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS most, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY 1, 2 HAVING count(*) > 10")
def grouped(spark, sf_dir):
    values = {"n": F.count("*"), "most": F.max("o_totalprice"), "n_customers": F.countDistinct("o_custkey")}
    return rows.aggregate(_read(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], values, F.col("n") > 10)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_rows(spark, sf_dir):
    return rows.top(_read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT c_custkey, c_name, CASE WHEN c_nationkey > 5 THEN c_nationkey END FROM customer WHERE c_custkey % 7 <> 0")
def insert_documents(spark, sf_dir):
    """Customers as JSON objects, some without a field and every seventh cut off, appended to the nations by their schema."""
    c = F.struct(F.col("c_custkey").alias("n_nationkey"), F.col("c_name").alias("n_name"), F.when(F.col("c_nationkey") > 5, F.col("c_nationkey")).alias("n_regionkey"))
    whole = F.to_json(c)
    docs = _read(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 7 == 0, F.left(whole, F.length(whole) - 3)).otherwise(whole).alias("doc"))
    return rows.append_json(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), docs, "doc")[0]


@query("SELECT count(*) AS table_count, CAST(sum(n) AS BIGINT) AS total_records FROM (" + " UNION ALL ".join(f"SELECT count(*) AS n FROM {n}" for n in _CORE) + ")")
def catalog_totals(spark, sf_dir):
    return rows.aggregate(table_counts(spark, sf_dir), [], {"table_count": F.count("*"), "total_records": F.sum("n_rows")})


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
