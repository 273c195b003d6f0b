"""Scans and changes of rows, each a new DataFrame; Catalyst plans and prunes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillon.functions.logic import holds
from quillon.session import set_checkpoint_dir

_KINDS = ("inner", "left", "right", "full", "left_semi", "left_anti")


class ArityError(ValueError):
    """A row has another number of values than the table has columns."""


def project(df: DataFrame, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """The columns (all of them for none or '*') of the rows where the predicate holds."""
    kept = df if where is None else df.where(where)
    return kept if not columns or columns == ["*"] else kept.select(*columns)


def append(df: DataFrame, rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows added at the end; with a column list, in its order, and null in the columns it leaves out."""
    if len(rows.columns) != len(columns or df.columns):
        raise ArityError(f"{len(rows.columns)} values for {len(columns or df.columns)} columns")
    named = rows.toDF(*(columns or df.columns))
    types = dict(df.dtypes)
    return df.unionAll(named.select(*[(F.col(c) if c in named.columns else F.lit(None)).cast(types[c]).alias(c) for c in df.columns]))


def update(df: DataFrame, changes: dict[str, Column], where: Column | None = None) -> DataFrame:
    """New values, computed from the old row, where the predicate holds (everywhere without one)."""
    hit = F.lit(True) if where is None else holds(where)
    types = dict(df.dtypes)
    return df.select(*[F.when(hit, changes[c].cast(types[c])).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in df.columns])


def delete(df: DataFrame, where: Column | None = None) -> DataFrame:
    """The rows where the predicate does not hold; none without a predicate."""
    return df.where(F.lit(False) if where is None else ~holds(where))


def _fresh(taken: list[str], name: str) -> str:
    """A column name that no given column has, in any case."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def _numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame, str]:
    """df in range partitions by the keys, cut off in the session's checkpoint folder, a small table (part, offset, n), and the name of the partition's column."""
    part = _fresh(df.columns, "part")
    set_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()).checkpoint()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("n"))
    return ranged, counts.select("part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), part


def with_positions(df: DataFrame, order: list[str], into: str = "position") -> DataFrame:
    """0-based position of each row in the order of unique keys, without one task that sorts the table.

    Rows are range-partitioned by the keys, written once, and numbered within each partition; what stands before a partition comes
    from one small count per partition. A given column named like the new one is replaced.
    """
    ranged, counts, part = _numbered(df, order)
    within, n = F.row_number().over(Window.partitionBy(part).orderBy(*order)), _fresh([*df.columns, part], "n")
    before = counts.select(F.col("part").alias(part), F.col("offset").alias(_fresh([*df.columns, part, n], "offset")))
    offset = before.columns[1]
    kept = [c for c in df.columns if c != into]
    return ranged.withColumn(n, within).join(before, part).select(*kept, (F.col(n) - 1 + F.col(offset)).cast("long").alias(into))


def row_at(df: DataFrame, order: list[str], position: int) -> DataFrame:
    """The row at a position, or none: only the range partition that holds it is ordered, wherever the position lies."""
    ranged, counts, part = _numbered(df, order)
    found = counts.where((F.col("offset") <= position) & (F.col("offset") + F.col("n") > position)).first()
    if found is None:
        return df.limit(0)
    within, n = F.row_number().over(Window.partitionBy(part).orderBy(*order)), _fresh([*df.columns, part], "n")
    return ranged.where(F.col(part) == found["part"]).withColumn(n, within).where(F.col(n) == position - found["offset"] + 1).select(df.columns)


def _hit(df: DataFrame, order: list[str], position: int) -> tuple[DataFrame, Column]:
    """The keys at a position under names of their own, and the condition that a row of df has them; null keys are equal."""
    named = {c: _fresh(df.columns, f"{c}_hit") for c in order}
    hit = row_at(df.select(*order), order, position).select(*[F.col(c).alias(to) for c, to in named.items()])
    same = F.lit(True)
    for c, to in named.items():
        same = same & F.col(c).eqNullSafe(F.col(to))
    return hit, same


def delete_at(df: DataFrame, order: list[str], position: int) -> DataFrame:
    """Without the row at a position, so that later positions move down; out of range changes nothing. Rows that share its keys go with it."""
    hit, same = _hit(df, order, position)
    return df.join(hit, same, "left_anti").select(df.columns)


def update_at(df: DataFrame, order: list[str], position: int, values: dict[str, Column]) -> DataFrame:
    """The row at a position with new values; out of range changes nothing. Rows that share its keys change with it."""
    hit, same = _hit(df, order, position)
    flag = _fresh([*df.columns, *hit.columns], "changed")
    joined = df.join(hit.withColumn(flag, F.lit(True)), same, "left")
    types = dict(df.dtypes)
    return joined.select(*[F.when(F.col(flag), values[c].cast(types[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def join(left: DataFrame, right: DataFrame, on: dict[str, str], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Equi-join by pairs of column names; null keys meet nothing, or each other if null_safe is set.

    The sides must have no column name in common but for the semi and anti joins, which return the left columns only.
    """
    if how not in _KINDS:
        raise ValueError(f"unknown join {how}")
    condition = F.lit(True)
    for a, b in on.items():
        condition = condition & (left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b])
    return left.join(right, condition, how)


def aggregate(df: DataFrame, by: list[str], values: dict[str, Column], having: Column | None = None) -> DataFrame:
    """One row for each group of `by` (nulls are a group), or one for the table without any; `having` sees the new columns."""
    made = df.groupBy(*by).agg(*[v.alias(n) for n, v in values.items()])
    return made if having is None else made.where(having)


def top(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in an order that should be total."""
    place = _fresh(df.columns, "place")
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(place) <= n).select(df.columns)


def append_json(df: DataFrame, documents: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """df with the objects of a text column appended by its schema, and the rows of documents that hold no such object.

    Fields that an object lacks are null and fields that df lacks are ignored, as with a column list.
    """
    bad, parsed = _fresh([*df.columns, *documents.columns], "malformed"), _fresh([*df.columns, *documents.columns], "parsed")
    given = documents.withColumn(parsed, F.from_json(column, StructType([*df.schema.fields, StructField(bad, StringType())]), {"columnNameOfCorruptRecord": bad}))
    wrong = F.col(column).isNull() | F.col(parsed).isNull() | F.col(f"`{parsed}`.`{bad}`").isNotNull()
    good = given.where(~wrong).select(*[F.col(f"`{parsed}`.`{c}`").alias(c) for c in df.columns])
    return df.unionAll(good), given.where(wrong).select(documents.columns)
