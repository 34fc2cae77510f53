"""Places in Spark's file systems: content digests made in tasks, small files, and folders that all executors share."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError

#: Files up to this size are digested by Spark's own reader, larger ones in pieces.
WHOLE_BYTES = 64 << 20
_PIECE = 1 << 22
#: Names that Hadoop and Arrow have for one kind of store.
_ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def arrow_store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Arrow's file system for a place as Spark names it."""
    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + (rest if colon else uri).lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(f"{_ARROW_SCHEMES.get(scheme, scheme)}:{rest}")


def _hadoop(spark: SparkSession, place: str):
    """(file system, path) in the JVM; the path is qualified."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return store, store.makeQualified(path)


def put(spark: SparkSession, place: str, content: bytes) -> None:
    """Writes a small file, on any file system that Spark knows."""
    store, path = _hadoop(spark, place)
    store.setWriteChecksum(False)
    try:
        out = store.create(path, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
    finally:
        store.setWriteChecksum(True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new name below ``spark.checkpoint.dir``; where that is unset, a local folder in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of files of any size, from (path, length)."""
    for batch in batches:
        digests = []
        for path in batch.column(0).to_pylist():
            store, name = arrow_store(path)
            digest = hashlib.sha256()
            with store.open_input_stream(name, compression=None) as source:
                while piece := source.read(_PIECE):
                    digest.update(piece)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=["path", "length", "sha256"])


def listed(spark: SparkSession, place: str) -> list[tuple[str, int]]:
    """(path, length) of a file, or of all files below a folder or named by a pattern."""
    store, path = _hadoop(spark, place)
    found = []
    for top in store.globStatus(path) or []:
        files = store.listFiles(top.getPath(), True)
        while files.hasNext():
            one = files.next()
            found.append((one.getPath().toString(), one.getLen()))
    if not found and not store.exists(path):
        raise InputError(f"{place}: there is no such file")
    return found


def file_digests(spark: SparkSession, place: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(path, length, sha256) of a file, or of all files below a folder or named by a pattern.

    Made in tasks, to which Spark deals the files by size; the driver knows names and lengths only.  Files of up to
    ``whole_bytes`` are read by Spark, on any file system that it knows.  Larger ones are read in pieces by Arrow, which
    must know their file system, and so are those that Spark's readers pass over (names that begin with _ or .).  Hadoop's
    own checksum files (.crc) don't count.
    """
    files = listed(spark, place)
    below = len(_hadoop(spark, _root(place))[1].toString().rstrip("/"))
    apart = [f for f in files if f[1] and (f[1] > whole_bytes or re.search(r"/[_.]", f[0][below:]))]
    empty = [(*f, hashlib.sha256().hexdigest()) for f in files if not f[1]]
    schema = "path string, length long, sha256 string"
    out = spark.createDataFrame(empty, schema)
    if apart:
        n = min(len(apart), 8 * spark.sparkContext.defaultParallelism)
        out = out.unionByName(spark.createDataFrame(apart, "path string, length long").repartition(n).mapInArrow(_in_pieces, schema))
    if len(empty) + len(apart) < len(files):
        read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(place).where(F.col("length") <= whole_bytes)
        out = out.unionByName(read.select("path", "length", F.sha2("content", 256).alias("sha256")))
    return out


def _root(place: str) -> str:
    """The folder that a pattern's files lie below; any other place itself."""
    fixed = re.split(r"[*?{\[]", place)[0]
    return place if fixed == place else fixed[: fixed.rfind("/") + 1] or "."


def content_digest(spark: SparkSession, place: str, whole_bytes: int = WHOLE_BYTES) -> str:
    """SHA-256 of a file's bytes; of a folder's or pattern's files, that of the lines "path below the folder, tab, digest".

    Lines are in the order of the paths, part by part, and come to the driver one after another.  The file's bytes don't.
    """
    digests = file_digests(spark, place, whole_bytes)
    store, root = _hadoop(spark, _root(place))
    if _root(place) == place and store.getFileStatus(root).isFile():
        return digests.first().sha256
    below = digests.select(F.substring("path", len(root.toString().rstrip("/")) + 2, 2**31 - 1).alias("name"), "sha256")
    whole = hashlib.sha256()
    for row in below.orderBy(F.split("name", "/"), "name").toLocalIterator():
        whole.update(f"{row.name}\t{row.sha256}\n".encode())
    return whole.hexdigest()
