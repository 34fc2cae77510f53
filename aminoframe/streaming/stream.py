"""Features of streams of sequences: the batch plan, unchanged, on ``readStream``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import Descriptor
from ..sources.store import shared_folder


def compute_stream(stream: DataFrame, descriptors, id_col: str = "id", seq_col: str = "sequence") -> DataFrame:
    """Features of a streaming table: a stateless projection, so any sink and output mode append will do."""
    from ..plans.engine import compute

    return compute(stream, descriptors, id_col, seq_col)


def readable(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at ``path``, a file or a folder."""
    glob = f"{path[:-1]}[{path[-1]}]"  # a stream's plain path must be a folder; a pattern may match a file
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(glob)


def compute_stream_once(spark: SparkSession, path: str, descriptor: Descriptor, id_col: str, seq_col: str, folder: str | None = None) -> DataFrame:
    """Runs what is at ``path`` now through a stream into Parquet and reads it back.

    ``folder`` takes the output and the stream's progress; a later call with the same folder adds only new files.
    """
    base = folder or shared_folder(spark, "stream")
    out = compute_stream(readable(spark, path), descriptor, id_col, seq_col)
    run = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")
