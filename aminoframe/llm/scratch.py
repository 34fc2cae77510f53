"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    The setting is read from the session.  Only where it is unset and Spark runs in one process (local tests) a local
    temporary folder is set; on a cluster that would be a folder which other machines don't see.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings for the length of a block."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def remove(folder: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    store, root = pyarrow.fs.FileSystem.from_uri(folder)
    if store.get_file_info(root).type == pyarrow.fs.FileType.Directory:
        store.delete_dir(root)


#: A table that has been written needs the shuffle files behind it no more.
_TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


class Scratch:
    """Tables of one run in a folder of its own; a table that is no longer read can be dropped."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder = spark, shared_dir(spark, name)
        self.made = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and read back: cuts lineage and survives lost executors."""
        self.made += 1
        path = f"{self.folder}/{name}-{self.made}"
        with settings(self.spark, _TIDY):
            df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch_path = path
        return table

    def bucketed(self, df: DataFrame, keys: list[str], name: str) -> DataFrame:
        """``df`` written in buckets by ``keys``: later joins and groupings on them don't shuffle this table again.

        The catalogue's entry, needed to write buckets, goes at once; the files stay until ``drop``.
        """
        self.made += 1
        path, entry = f"{self.folder}/{name}-{self.made}", f"{name}_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with settings(self.spark, _TIDY):
            df.write.bucketBy(n, *keys).option("path", path).saveAsTable(entry)
        table = self.spark.table(entry)
        table.schema  # noqa: B018  resolved while the entry is there
        self.spark.sql(f"DROP TABLE {entry}")
        table._scratch_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            remove(table._scratch_path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a folder of its own and read back."""
    return Scratch(df.sparkSession, name).write(df, "table")


#: A key is hot if it has at least so many rows, and one row in so many of all rows.
HOT_ROWS, HOT_SHARE = 10_000, 5_000


def join_counted(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join with ``facts``, which has one row for each ``key`` and tells how many of ``rows`` have it.

    Hot keys are at most HOT_SHARE by their definition, so their facts are broadcast and their rows never meet in one
    task.  Both tables should be read from files, as each is read twice.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot = facts.where(F.col(count) >= limit)
    cold = facts.where((F.col(count) < limit) | F.col(count).isNull())
    if total < limit or hot.isEmpty():
        return rows.join(facts, key)
    names = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(names, key, "left_anti").join(cold, key))
