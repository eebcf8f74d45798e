"""Keyed tables on disk that a write touches only where it changes them.

A table's rows lie in folders by a hash of its key, or of the columns of the key that it is
asked by. Whoever asks for some keys reads their folders alone, by a partition filter; whoever
inserts appends files to folders; whoever updates writes the folders anew in which a row does
change, and no other, by dynamic partition overwrite of rows that were put aside first. Each
key is there once. Writes may be repeated: what was written before is found and left alone.

One writer at a time. `buckets` is a table's own for good; it is right when one folder is a
task's work, and a write's keys should touch few of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from wordweave.operators.store import first_of_each
from wordweave.session import made, released, written

BUCKETS = 64


class KeyedTable:
    """Rows of `schema` at a path, each key once, in folders by a hash of the columns `by`."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: Sequence[str], by: Sequence[str] = (), buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.by, self.buckets = spark, path, list(keys), list(by or keys), buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        made(spark, path)

    def dealt(self, df: DataFrame) -> DataFrame:
        """df with its columns cast to the table's types, missing ones null, and `bucket`; of requests the columns `by` alone."""
        have = set(df.columns)
        fields = [f for f in self.schema.fields if f.name in have] if not have >= set(self.keys) else self.schema.fields
        rows = df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int"))

    def _read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(StructType(list(self.schema.fields)).add("bucket", IntegerType())).parquet(self.path)
        return rows if buckets is None else rows.filter(F.col("bucket").isin(list(buckets)) if buckets else F.lit(False))

    @staticmethod
    def _touched(rows: DataFrame) -> list[int]:
        """The folders of rows; the driver gets as many numbers as there are folders at most."""
        return sorted(r.bucket for r in rows.select("bucket").distinct().collect())

    def rows(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table, or some of its folders."""
        return self._read(buckets).drop("bucket")

    def folders(self, requests: DataFrame) -> list[int]:
        """The folders that the keys of requests (by ..) fall in."""
        return self._touched(self.dealt(requests))

    def lookup(self, requests: DataFrame) -> DataFrame:
        """Rows of the keys in requests (by ..), read from their folders alone. requests are read twice."""
        asked = self.dealt(requests).select(*self.by, "bucket").distinct()
        return self._read(self._touched(asked)).join(asked, [*self.by, "bucket"], "left_semi").drop("bucket")

    def _same(self) -> Column:
        out = F.col("n.bucket") == F.col("o.bucket")
        for k in self.keys:
            out = out & F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
        return out

    def insert(self, new: DataFrame, *order: Column | str) -> DataFrame:
        """Appends of new the first row of each key by `order`, where the table hasn't the key; returns what it appended. Old rows are asked for their keys only."""
        new = written(first_of_each(self.dealt(new), self.keys, *order), "insert")
        old = self._read(self._touched(new)).select(*self.keys, "bucket")
        fresh = written(new.alias("n").join(old.alias("o"), self._same(), "left_anti"), "fresh")
        fresh.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)
        released(new)
        return fresh.drop("bucket")

    def _overwritten(self, aside: DataFrame, folders: Sequence[int]) -> list[int]:
        """Writes some folders anew, with the rows that a table put aside has for them."""
        if folders:
            rows = aside.filter(F.col("bucket").isin(list(folders))).select(*self.schema.names, "bucket")
            rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return list(folders)

    def upsert(self, new: DataFrame, *order: Column | str) -> list[int]:
        """Of old and new rows of a key the first by `order` stays, among equals the old one. Returns the folders that were written anew: those where a new row came first."""
        new = written(first_of_each(self.dealt(new), self.keys, *order), "upsert")
        both = self._read(self._touched(new)).withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
        next_ = written(first_of_each(both, self.keys, *order, "_new"), "next")
        changed = self._overwritten(next_, self._touched(next_.filter("_new")))
        released(new, next_)
        return changed

    def update(self, changes: DataFrame, column: str) -> list[int]:
        """Sets `column` where changes (keys .., column) has the key, the greatest of several; null changes nothing, and neither does a key that isn't there. Returns the folders written anew."""
        new = self.dealt(changes).groupBy(*self.keys, "bucket").agg(F.max(column).alias("_new")).filter("_new is not null")
        new = written(new, "changes")
        old = self._read(self._touched(new))
        after = old.alias("o").join(new.alias("n"), self._same(), "left").select("o.*", "_new").withColumn("_moved", F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col(column)))
        return self._moved(after.withColumn(column, F.coalesce("_new", column)), new)

    def fill(self, column: str, value: Column) -> list[int]:
        """Sets `column` to `value` where it is null. Returns the folders written anew; those without a null, or where the value is null too, are left alone."""
        holes = self._touched(self._read().filter(F.col(column).isNull()).select("bucket"))
        old = self._read(holes)
        return self._moved(old.withColumn("_moved", F.col(column).isNull() & value.isNotNull()).withColumn(column, F.coalesce(F.col(column), value)))

    def _moved(self, after: DataFrame, *used: DataFrame) -> list[int]:
        after = written(after, "after")
        changed = self._overwritten(after, self._touched(after.filter("_moved")))
        released(after, *used)
        return changed

    def add(self, deltas: DataFrame, column: str, batch: int) -> list[int]:
        """Adds deltas (keys .., column) to `column`, once for each batch: the table's `batch` says which one a key has had last."""
        new = written(self.dealt(deltas).drop("batch"), "deltas")
        old = self._read(self._touched(new))
        both = old.withColumn("_d", F.lit(None).cast("long")).unionByName(new.withColumn("_d", F.col(column).cast("long")).withColumn(column, F.lit(None).cast(self.schema[column].dataType)), allowMissingColumns=True)
        rows = both.groupBy(*self.keys, "bucket").agg(F.max(column).alias(column), F.sum("_d").alias("_d"), F.max("batch").alias("batch"))
        rows = rows.withColumn("_moved", F.col("_d").isNotNull() & (F.coalesce("batch", F.lit(-1)) < batch))
        rows = rows.withColumn(column, F.coalesce(F.col(column), F.lit(0)) + F.when(F.col("_moved"), F.col("_d")).otherwise(0)).withColumn("batch", F.when(F.col("_moved"), F.lit(batch)).otherwise(F.col("batch")))
        return self._moved(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields], "bucket", "_moved"), new)
