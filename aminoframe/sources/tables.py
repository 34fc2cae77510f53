"""Reading and writing tables of sequences: FASTA, CSV and Parquet."""

from __future__ import annotations

import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IdColumnError, IdError, InputError

FASTA, CSV, PARQUET = (".fasta", ".fa", ".faa"), (".csv",), (".parquet", ".pq")
_SCHEMA = "id string, sequence string"


def _suffix(path: str) -> str:
    return Path(path.rstrip("/")).suffix.lower()


def _parse(raw: bytes) -> Iterator[tuple[str, str]]:
    """Records of FASTA text, lines stripped; what stands before the first header is left out."""
    name, parts = None, []
    for line in raw.decode("utf-8").splitlines():
        line = line.strip()
        if line.startswith(">"):
            if name is not None:
                yield name, "".join(parts)
            name, parts = (line[1:].split() or [""])[0], []
        elif line and name is not None:
            parts.append(line.upper())
    if name is not None:
        yield name, "".join(parts)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text up to the next header's >, file, where the split begins), in the order of the file.

    Only a file's first text can stand before a header; all others have lost theirs.
    """
    split = None
    for batch in batches:
        rows: list[tuple[str, str]] = []
        for raw, file, begin in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            first = begin == 0 and split != (file, begin)
            split = file, begin
            rows += _parse(raw if first else b">" + raw)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["id", "sequence"])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, sequence) of a FASTA file, or of all files that a folder or pattern names, of any size.

    Files are split over tasks before the lines that begin with >.  The id is a header's first word, "" if it has none;
    what stands before a file's first header is left out.  Bytes that aren't UTF-8 fail when rows are read.
    """
    try:
        text = spark.read.option("lineSep", "\n>").text(path)
    except PySparkException as e:
        raise InputError(f"{path}: {e.getCondition() or e}") from e
    placed = text.select(F.col("value").cast("binary").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"))
    return placed.mapInArrow(_records, _SCHEMA)


def read_sequences(spark: SparkSession, path: str, seq_col: str = "sequence", id_col: str = "id", check_ids: bool = True) -> DataFrame:
    """(id, sequence) by the path's suffix; ids and sequences are strings, sequences stripped and upper-cased.

    CSV columns are read as text, so an id 001 stays as it is; a malformed row fails.  Ids are checked in one pass.
    """
    suffix = _suffix(path)
    if suffix in FASTA:
        rows = read_fasta(spark, path)
    elif suffix in CSV + PARQUET:
        try:
            table = spark.read.csv(path, header=True, mode="FAILFAST", multiLine=True, inferSchema=False, escape='"') if suffix in CSV else spark.read.parquet(path)
        except PySparkException as e:
            raise InputError(f"{path}: {e.getCondition() or e}") from e
        if id_col not in table.columns:
            raise IdColumnError(f"{path} has no column {id_col!r}; name the id column with --id-col")
        if seq_col not in table.columns:
            raise InputError(f"{path} has no column {seq_col!r}")
        rows = table.select(F.col(id_col).cast("string").alias("id"), F.upper(F.trim(F.col(seq_col).cast("string"))).alias("sequence"))
    else:
        raise InputError(f"{path}: unknown kind of file; {', '.join(FASTA + CSV + PARQUET)} are read")
    if check_ids:
        require_ids(rows)
    return rows


def require_ids(rows: DataFrame) -> None:
    """Ids must be there and differ; at most five of those that repeat are named."""
    counts = rows.groupBy("id").count()
    try:
        bad = counts.where("id is null or id = '' or count > 1").orderBy("id").limit(6).collect()
    except (PySparkException, Py4JJavaError) as e:
        raise InputError(f"the input can't be read: {str(e)[:300]}") from e
    if any(not r.id for r in bad):
        raise IdError("some records have no id")
    if bad:
        raise IdError("ids repeat: " + ", ".join(r.id for r in bad[:5]))


def write_table(df: DataFrame, path: str, single_file: bool = True) -> None:
    """CSV or Parquet by suffix.

    With ``single_file`` the path is one file on a file system that the tasks share with the caller: they write parts
    beside it, which are then joined batch by batch.  Otherwise it is a folder of Spark's part files, for results of any
    size.
    """
    suffix = _suffix(path)
    if suffix not in CSV + PARQUET:
        raise InputError(f"{path}: unknown kind of file; {', '.join(CSV + PARQUET)} are written")
    if not single_file:
        writer = df.write.mode("overwrite")
        writer.option("header", True).csv(path) if suffix in CSV else writer.parquet(path)
        return
    import pyarrow.csv
    import pyarrow.parquet

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    schema = pa.schema([(f.name, pa.string() if f.dataType.typeName() == "string" else pa.float64()) for f in df.schema])
    make = pyarrow.csv.CSVWriter if suffix in CSV else pyarrow.parquet.ParquetWriter
    with tempfile_beside(path) as parts, make(path, schema) as out:
        df.write.parquet(parts)
        for file in sorted(Path(parts.removeprefix("file://")).glob("part-*.parquet")):
            for batch in pyarrow.parquet.ParquetFile(file).iter_batches(1000):
                out.write_batch(batch.cast(schema))


@contextmanager
def tempfile_beside(path: str) -> Iterator[str]:
    """A folder of part files next to a local output, gone afterwards."""
    folder = Path(path).absolute().with_name(f".{Path(path).name}-{uuid.uuid4().hex}")
    try:
        yield folder.as_uri()
    finally:
        shutil.rmtree(folder, ignore_errors=True)
