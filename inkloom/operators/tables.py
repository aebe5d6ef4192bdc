"""What a store of tables does: idempotent inserts, upserts, updates by another table, deletes, runs, ordinals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """old and those of new whose key isn't there, of new rows of one key the first."""
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*new.columns), F.col(order)).alias("_r")).select("_r.*")
    return old.unionByName(first.join(old, keys, "left_anti").select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and those of old whose key it doesn't have."""
    return old.join(new, keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def update_from(rows: DataFrame, other: DataFrame, key: str, column: str, default) -> DataFrame:
    """rows with a column set from another table by key, or to a default."""
    value = other.select(key, F.col(column).alias("_v"))
    return rows.drop(column).join(value, key, "left").withColumn(column, F.coalesce("_v", F.lit(default))).drop("_v")


def least_of(rows: DataFrame, other: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows with the least value that another table has for their key, null where it has none: a scalar subquery."""
    return rows.join(other.groupBy(key).agg(F.min(value).alias(name)), key, "left")


def delete_orphans(rows: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """rows whose key is in use; null keys aren't."""
    return rows.join(used.select(key), key, "left_semi")


def delete_where_in(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def ordinals(rows: DataFrame, group: str, order: str, name: str = "ordinal") -> DataFrame:
    """Position of each row within its group, from 0."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)


def start_run(runs: DataFrame, root: str, mode: str, started: int) -> DataFrame:
    """runs (run_id, root, mode, status, started, finished) and a new one, running, with the next id. A root other than
    that of the latest run is an error: its rows would be taken for those of the other."""
    last = latest(runs).select("run_id", "root").first()
    if last is not None and last["root"] != root:
        raise ValueError(f"the store was made from {last['root']}, not from {root}")
    new = runs.sparkSession.createDataFrame([(last["run_id"] + 1 if last else 1, root, mode, "running", started, None)], runs.schema)
    return runs.unionByName(new)


def end_run(runs: DataFrame, run_id: int, status: str, finished: int) -> DataFrame:
    mine = F.col("run_id") == run_id
    return runs.withColumn("status", F.when(mine, status).otherwise(F.col("status"))).withColumn("finished", F.when(mine, F.lit(finished).cast("long")).otherwise(F.col("finished")))


def backfill(rows: DataFrame, version: str, current: int, derive) -> DataFrame:
    """rows with what ``derive`` makes of those whose version column is missing or older; the others are not touched,
    and all have the current version afterwards. ``derive`` maps rows to rows of the same columns."""
    stale = F.col(version).isNull() | (F.col(version) < current)
    done = derive(rows.where(stale)).withColumn(version, F.lit(current).cast(rows.schema[version].dataType)).select(*rows.columns)
    return rows.where(~stale).unionByName(done)


def latest(runs: DataFrame, ident: str = "run_id") -> DataFrame:
    return runs.orderBy(F.desc(ident)).limit(1)


def limited(rows: DataFrame, n: int) -> DataFrame:
    """At most n rows; 0 or less is no limit."""
    return rows.limit(n) if n > 0 else rows


def unseen(files: DataFrame, done: DataFrame, path: str = "path") -> DataFrame:
    """Files that were neither parsed nor found to be duplicates before; failed ones come again."""
    return files.join(done.select(path), path, "left_anti")
