"""Exact deduplication by stateful streaming, native operations only.

Documents are recorded in an inbox (id, digest, normalised text), one load for each batch.  A Structured Streaming query
reads what is new in the inbox and keeps one state row per digest, without expiry, in a disk-backed (RocksDB) store: the
smallest id, its content locator (the inbox file that holds its text) and the group's size.  On hits full bytes are
checked: the texts of a load whose digest the state has more than once are compared with each other and with the kept
document's text, which the locator finds, also if it came with an earlier batch.

The folder survives the session: batches can be added at any time, and results cover all of them.  One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, join_counted, remove, settings, shared_dir

_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each small store reserves megabytes of disk
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # a call is one batch: its stores' memory is free right after
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
}
_LAST = (1 << 63) - 1
_INBOX = "doc_id long, digest binary, text string, load string"
_LOADS = "name string, load string"


def normalised(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` is one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _marked_by(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """The ``rows`` whose digest begins like one of ``hits`` does, so all of those and few others; without a shuffle.

    The first 24 bits of the hits are marked in a bitmap, which is broadcast: 2 MB at most, however many they are.
    """
    start = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 8)
    part, place = F.bitmap_bucket_number(start), F.bitmap_bit_position(start)
    marks = hits.groupBy(part.alias("__part")).agg(F.bitmap_construct_agg(place).alias("__marks"))
    byte = F.conv(F.hex(F.expr("substring(__marks, int(__place div 8) + 1, 1)")), 16, 10).cast("int")
    placed = rows.withColumn("__part", part).withColumn("__place", place).join(F.broadcast(marks), "__part")
    return placed.where(F.floor(byte / F.pow(F.lit(2), F.col("__place") % 8)) % 2 == 1).select(*rows.columns)


class ExactDedup:
    """An incremental exact deduplicator whose inbox and state live in ``folder`` (shared by all executors).

    ``add`` may be called again and again; ``groups`` and ``rows`` then cover all rows added so far.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, digest: Callable[[Column], Column] = sha256) -> None:
        self.spark, self.folder, self.digest = spark, folder or shared_dir(spark, "exact"), digest
        self.scratch = Scratch(spark, "exact-steps")

    def _names(self, what: str) -> list[str]:
        """The entries of a subfolder: a name a load."""
        store, root = pyarrow.fs.FileSystem.from_uri(self.folder)
        if store.get_file_info(f"{root}/{what}").type != pyarrow.fs.FileType.Directory:
            return []
        return sorted(f.base_name for f in store.get_file_info(pyarrow.fs.FileSelector(f"{root}/{what}")) if not f.base_name.startswith(("_", ".")))

    def _loads(self) -> dict[str, str]:
        """Loads that are complete, by the name of their batch."""
        return {name[len("name=") :].rsplit("@", 1)[0]: name.rsplit("@", 1)[1] for name in self._names("batches")}

    def _mark(self, what: str, name: str) -> None:
        """An empty file with the name."""
        store, root = pyarrow.fs.FileSystem.from_uri(self.folder)
        store.create_dir(f"{root}/{what}", recursive=True)
        store.open_output_stream(f"{root}/{what}/{name}").close()

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> None:
        """Records ``docs`` in the inbox, folds them into the keyed state and checks the bytes of hits.

        A batch is counted once: adding one of the same name again, or without a name one of the same ids and texts,
        only finishes what an interrupted call has left undone.
        """
        loads = self._loads()
        for orphan in set(self._names("inbox")) - {f"load={x}" for x in loads.values()}:
            remove(f"{self.folder}/inbox/{orphan}")  # of a call that was interrupted before its batch was complete
        if batch is None or f"given-{batch}" not in loads:
            load = uuid.uuid4().hex
            path = f"{self.folder}/inbox/load={load}"
            text = normalised(F.col(text_col))
            docs.select(F.col(id_col).cast("long").alias("doc_id"), self.digest(text).alias("digest"), text.alias("text")).write.parquet(path)
            name = f"given-{batch}"
            if batch is None:
                rows = self.spark.read.schema("doc_id long, digest binary").parquet(path)
                n, total = rows.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "digest").cast("decimal(38,0)"))).first()
                name = f"content-{n}-{total or 0}"
            if name in loads:
                remove(path)
            else:
                self._mark("batches", f"name={name}@{load}")
        self._fold()
        self._check()

    def _fold(self) -> None:
        inbox = self.spark.readStream.schema("doc_id long, digest binary, load string").parquet(f"{self.folder}/inbox")
        locator = F.substring_index("_metadata.file_path", "/", -2)
        smallest = F.min(F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), locator.alias("file")))
        state = inbox.groupBy("digest").agg(smallest.alias("keep"), F.count("*").alias("group_size"))
        with settings(self.spark, _STATE_CONF):
            run = state.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/state").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{self.folder}/updates/batch={n}")).trigger(availableNow=True).start()
            run.awaitTermination()

    def _check(self) -> None:
        """Compares the texts of hits in loads that no call has checked."""
        done = set(self._names("checked"))
        new = [x for x in self._loads().values() if x not in done]
        if not new:
            return
        inbox = self.spark.read.schema(_INBOX).parquet(f"{self.folder}/inbox")
        load = F.substring_index("keep.file", "/", 1)
        hits = self.groups().where("group_size > 1").select("digest")
        if done:  # of those only the new loads'
            hits = hits.join(inbox.where(F.col("load").isin(new)).select("digest").distinct(), "digest")
        hits = self.scratch.write(hits, "hits")
        texts = _marked_by(hits, inbox.where(F.col("load").isin(new)).select("digest", "text"))
        if done:  # the document that was kept before these loads, by its locator
            before = self._updates().where(load.isin([f"load={x}" for x in done])).groupBy("digest").agg(F.min("keep").alias("keep"))
            before = self.scratch.write(before.join(hits, "digest").select("digest", "keep.id", "keep.file"), "before")
            files = sorted(r.file for r in before.select("file").distinct().collect())  # names of inbox files
            if files:
                kept = self.spark.read.schema("doc_id long, digest binary, text string").parquet(*(f"{self.folder}/inbox/{f}" for f in files))
                kept = kept.withColumn("id", F.coalesce("doc_id", F.lit(_LAST))).join(before, ["digest", "id"])
                texts = texts.unionByName(kept.select("digest", "text"))
        #: Copies collapse on the map side, so a group of any size sends one text per task.
        compared = texts.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b"))
        odd = compared.where("a <> b").select(F.lower(F.hex("digest"))).first()
        if odd:
            raise ValueError(f"two different texts share the digest {odd[0]}")
        self.scratch.drop(hits)
        for load in new:
            self._mark("checked", load)

    def rows(self) -> DataFrame:
        """doc_id, digest of all rows added."""
        return self.spark.read.schema("doc_id long, digest binary").parquet(f"{self.folder}/inbox")

    def _updates(self) -> DataFrame:
        return self.spark.read.schema("digest binary, keep struct<id:long,file:string>, group_size long").parquet(f"{self.folder}/updates")

    def groups(self) -> DataFrame:
        """digest, keep_id, file (the locator: below the inbox), group_size: the newest state of every digest."""
        newest = self._updates().groupBy("digest").agg(F.min("keep").alias("keep"), F.max("group_size").alias("group_size"))
        return newest.select("digest", F.col("keep.id").alias("keep_id"), F.col("keep.file").alias("file"), "group_size")

    def results(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256 of every row added so far."""
        states = self.scratch.write(self.groups().select("digest", F.nullif("keep_id", F.lit(_LAST)).alias("keep_id"), "group_size"), "states")
        joined = join_counted(self.rows(), states, "digest", "group_size")
        return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, batch: str | None = None) -> DataFrame:
    """One row per row added: doc_id, keep_id, group_size, kept, text_sha256 of the normalised text.

    Null, like empty, is the empty text; a text of white space only is one space.  The smallest id of a group stays; a
    null id counts as the largest and its keep_id is null only if the whole group has none.  Rows that repeat the kept
    id are all kept.  Two different texts with one SHA-256 digest fail the run instead of losing one of them.  Other
    columns are ignored.

    With a ``folder`` of earlier calls the rows of their batches are in the result too, decided anew over all batches.
    A retried call counts its batch once (``ExactDedup.add``).
    """
    dedup = ExactDedup(docs.sparkSession, folder)
    dedup.add(docs, id_col, text_col, batch)
    return dedup.results()


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
