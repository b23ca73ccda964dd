"""Keyed writes as DataFrames: the table after the write, and each row's status against the table before it.

Parquet has no MERGE.  ``inserted``, ``upserted`` and ``replaced`` return the new content; ``commit`` writes it beside the old
one and a pointer file with the next number, so readers see one version or the other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: SQL column types of a table made from a first row's Python types.
SQL_TYPES = {str: "string", int: "bigint", float: "double", bool: "int", dict: "string", list: "string"}


def inferred_schema(row: dict) -> str:
    """Columns for a new table from its first row; other types, None and subclasses become text."""
    return ", ".join(f"`{k}` {SQL_TYPES.get(type(v), 'string')}" for k, v in row.items())


def encoded(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = {f.name for f in rows.schema if f.dataType.typeName() in ("struct", "map", "array")}
    return rows.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in rows.columns])


def last_of_each(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Rows apply in order, so the last one of a key stands."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(position)))
    return rows.withColumn("_n", place).where("_n = 1").drop("_n")


def statuses(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``row_id`` and ``write_status``, judged by what was there before the batch."""
    before = target.select(*keys).distinct().withColumn("_there", F.lit(True))
    found = rows.join(before, keys, "left")
    return found.withColumn("row_id", F.concat_ws(",", *[F.col(k).cast("string") for k in keys])).withColumn("write_status", F.when(F.col("_there"), "updated").otherwise("inserted")).drop("_there")


def inserted(target: DataFrame, rows: DataFrame) -> DataFrame:
    return target.unionByName(rows, allowMissingColumns=True)


def _one_of_each(rows: DataFrame, keys: list[str], position: str | None) -> DataFrame:
    """The last row of each key by ``position``; without one, where rows have no order, the greatest of its rows as JSON."""
    if position:
        return last_of_each(rows, keys, position).drop(position)
    return last_of_each(rows.withColumn("_at", F.to_json(F.struct(*rows.columns))), keys, "_at").drop("_at")


def upserted(target: DataFrame, rows: DataFrame, keys: list[str], position: str | None = None) -> DataFrame:
    """Columns that the rows have replace the old values, nulls included; other columns keep theirs.

    A key's last row by ``position`` (a column that isn't written) stands; without one the greatest row does.
    """
    rows = _one_of_each(rows, keys, position)
    new = rows.select(*[F.col(c).alias(f"_new_{c}") for c in rows.columns], F.lit(True).alias("_new"))
    old = target.withColumn("_old", F.lit(True))
    met = old.join(new, [old[k] == new[f"_new_{k}"] for k in keys], "full")
    return met.select(*[F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(old[c]).alias(c) if c in rows.columns else old[c] for c in target.columns])


def replaced(target: DataFrame, rows: DataFrame, keys: list[str], position: str | None = None) -> DataFrame:
    """Whole rows replace those with their key; columns that the rows lack become null.  Of a key's rows one stands, as in ``upserted``."""
    rows = _one_of_each(rows, keys, position)
    return target.join(rows.select(*keys), keys, "left_anti").select(*target.columns).unionByName(rows, allowMissingColumns=True)


def tenant_filled(rows: DataFrame, **values: str) -> DataFrame:
    """Null tenant columns take the context's values."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in values.items()})


def commit(content: DataFrame, folder: str) -> str:
    """Writes a new version below ``folder`` and makes it the current one; returns its path."""
    spark, version = content.sparkSession, f"{folder}/v-{uuid.uuid4().hex[:12]}"
    content.write.parquet(version)
    number = max(_pointers(spark, folder), default=0) + 1
    pointer = spark.createDataFrame([(version,)], "path string").coalesce(1).write
    # A folder that is there refuses a second commit of its number; one without its success file isn't a pointer yet.
    pointer.mode("error").text(f"{folder}/current-{number:09d}")
    return version


def _pointers(spark, folder: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/current-*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [int(f.getPath().getParent().getName()[8:]) for f in found or []]


def current(spark, folder: str) -> DataFrame:
    """The version that the pointer with the highest number names."""
    return spark.read.parquet(spark.read.text(f"{folder}/current-{max(_pointers(spark, folder)):09d}").first()[0])


def merged(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """Three-way merge by key: ``(key, row, conflict)`` with the row as JSON, null if deleted.

    A key conflicts if both sides changed it, in different ways; then ``row`` is ours.
    """
    side = lambda df, name: df.select(F.col(key), F.to_json(F.struct(*sorted(df.columns))).alias(name))
    met = side(base, "b").join(side(ours, "o"), key, "full").join(side(theirs, "t"), key, "full")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    row = F.when(same("o", "b"), F.col("t")).otherwise(F.col("o"))
    return met.select(key, row.alias("row"), (~same("o", "b") & ~same("t", "b") & ~same("o", "t")).alias("conflict"))
