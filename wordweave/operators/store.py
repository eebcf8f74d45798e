"""Writes to keyed tables. Spark enforces no key, so every write here returns the whole next state, with each key once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordweave.session import written


def first_of_each(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each key by `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def _same(a: str, b: str, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """old, and of new the first row of each key that old hasn't."""
    fresh = first_of_each(new, keys, *order).alias("n").join(old.select(*keys).alias("o"), _same("n", "o", keys), "left_anti")
    return old.unionByName(fresh.select("n.*"), allowMissingColumns=True)


def insert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ranked edges: a key's first write stays, with the least rank within one write."""
    return insert_or_ignore(old, new, ["config_id", "src_id", "dst_id"], "rank")


def with_ids(old: DataFrame, new: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """insert_or_ignore for tables with a running `id`: new keys are numbered by `order` after the last one."""
    fresh = first_of_each(new, keys, *order).alias("n").join(old.select(*keys).alias("o"), _same("n", "o", keys), "left_anti").select("n.*").drop("id")
    return appended(old, fresh, *order)


def appended(old: DataFrame, new: DataFrame, *order: Column | str) -> DataFrame:
    """old and all rows of new, numbered by `order` after old's last id.

    Rows are dealt by ranges of the order and sorted, so that a row's number is its place in its
    range and the rows of the ranges before; no task sees more than a range.
    """
    rows = new.drop("id").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    last = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = rows.join(F.broadcast(counts), "_part").crossJoin(F.broadcast(last))
    return old.unionByName(out.withColumn("id", F.col("_last") + F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before", "_last"), allowMissingColumns=True)


def found(requests: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """requests (keys ..) with the other columns of a table that has each key once, null where it misses; nothing is created."""
    return requests.join(table, list(keys), "left")


def upsert_records(old: DataFrame, new: DataFrame) -> DataFrame:
    """Records by (norm_a, norm_b): the fewest hops win, an older one against equal ones, as replacing takes strictly fewer."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return first_of_each(both, ["norm_a", "norm_b"], F.col("hops").asc_nulls_last(), "_new", "created_at").drop("_new")


def update_from(old: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """old with `column` replaced where changes (key, column) has the key; one change a key counts."""
    new = changes.groupBy(key).agg(F.max(column).alias("_new"))
    return old.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).select(old.columns)


def fill_nulls(old: DataFrame, column: str, value: Column) -> DataFrame:
    return old.withColumn(column, F.coalesce(F.col(column), value))


def newer_than(df: DataFrame, last: int, column: str = "id") -> DataFrame:
    """Rows after a watermark; Parquet statistics prune what lies before it."""
    return df.filter(F.col(column) > last)
