"""Ids of streams: a batch table's ids are checked in one pass, a stream's against all that came before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IdError

_ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def repeats(stream: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, n) of a stream, for output mode update: each id that came in the micro-batch and has now come ``n`` > 1 times.

    A missing id (null or empty) is reported as "" from its first row on.  The state has a count for each id and no
    expiry, keyed and dealt by id; rows of one id are counted before the shuffle.
    """
    ids = stream.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"))
    return ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id = ''")


def report_repeats(spark: SparkSession, stream: DataFrame, folder: str, id_col: str = "id") -> DataFrame:
    """(batch, id, n): what ``repeats`` reports of all that the stream has now, added to the reports of earlier calls.

    ``folder`` keeps the state, the progress and the reports: a later call, also of a new session, goes on from there, and
    finds ids that came before it again.  A batch that is run again after a failure replaces its own report.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/repeats/batch={number}")

    before = {k: spark.conf.get(k, None) for k in _ROCKS}
    for k, v in _ROCKS.items():
        spark.conf.set(k, v)
    try:
        run = repeats(stream, id_col).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = "id string, n long, batch int"
    made = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/repeats")
    if not made.getFileSystem(spark._jsc.hadoopConfiguration()).exists(made):
        return spark.createDataFrame([], "batch int, id string, n long")
    return spark.read.schema(schema).parquet(f"{folder}/repeats").select("batch", "id", "n")


def require_unique(spark: SparkSession, stream: DataFrame, folder: str, id_col: str = "id") -> None:
    """Raises as ``sources.tables.require_ids`` does, if an id is missing or came twice, in this call or an earlier one."""
    bad = report_repeats(spark, stream, folder, id_col).select("id").distinct().orderBy("id").limit(6).collect()
    if any(not r.id for r in bad):
        raise IdError("some records have no id")
    if bad:
        raise IdError("ids repeat: " + ", ".join(r.id for r in bad[:5]))
