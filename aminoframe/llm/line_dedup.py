"""Reversible line deduplication: sharded cuckoo filters backed by exact reference counts.

The index counts for every line key in how many documents it stands.  The counts are exact and kept as a table in shards
by key; ``insert`` and ``delete`` fold a batch of documents in or out by adding its counts.  Keys at or above the
threshold are in their shard's cuckoo filter, which takes deletions, so a filter follows the counts both ways.  A line
is looked up in the filter first; only what the filter lets through is looked up in the exact table, so a filter's false
positives never drop a line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
import xxhash
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, join_counted, remove, shared_dir

SPACE = b" \t\n\x0b\x0c\r"
#: Frequent keys of an index whose exact table (16 bytes a key) and filters are sent to the tasks; above, they are joined.
SENT_KEYS = 500_000
SHARD_KEYS = 50_000
_OVERFULL = "a cuckoo filter is over-full"
_KEY = np.dtype([("hi", "<u8"), ("lo", "<u8")])


class CuckooFilter:
    """A partial-key cuckoo filter: 16-bit fingerprints, four to a bucket, two buckets a key; add, remove, contains.

    Keys are 64-bit hashes.  ``add`` returns False if a key finds no place; the filter is then over-full, and its owner
    builds a larger one from the keys (the index has them all in its exact table).
    """

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int, table: np.ndarray | None = None) -> None:
        buckets = 1 << max(1, int(np.ceil(capacity / (0.85 * self.SLOTS))) - 1).bit_length()
        self.table = np.zeros((buckets, self.SLOTS), dtype=np.uint16) if table is None else table

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        prints = (keys >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        one = keys & mask
        return prints, one, self._other(one, prints)

    def _other(self, place, prints):
        return (place ^ (np.asarray(prints).astype(np.uint64) * np.uint64(0x5BD1E995))) & np.uint64(len(self.table) - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, one, two = self._places(keys)
        return (self.table[one] == prints[:, None]).any(axis=1) | (self.table[two] == prints[:, None]).any(axis=1)

    def add(self, keys: np.ndarray) -> bool:
        prints, one, two = self._places(keys)
        for p, a, b in zip(prints.tolist(), one.tolist(), two.tolist(), strict=True):
            for place in (a, b):
                free = np.flatnonzero(self.table[place] == 0)
                if len(free):
                    self.table[place, free[0]] = p
                    break
            else:
                place = b
                for kick in range(self.KICKS):
                    slot = kick % self.SLOTS
                    p, self.table[place, slot] = int(self.table[place, slot]), p
                    place = int(self._other(np.uint64(place), p))
                    free = np.flatnonzero(self.table[place] == 0)
                    if len(free):
                        self.table[place, free[0]] = p
                        break
                else:
                    return False
        return True

    def remove(self, keys: np.ndarray) -> None:
        """Takes out keys that were added."""
        prints, one, two = self._places(keys)
        for p, a, b in zip(prints.tolist(), one.tolist(), two.tolist(), strict=True):
            for place in (a, b):
                held = np.flatnonzero(self.table[place] == p)
                if len(held):
                    self.table[place, held[0]] = 0
                    break


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line: stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased."""
    return [line.strip(SPACE).lower() for line in text.split(b"\n")]


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _texts(column: pa.Array) -> Iterator[bytes]:
    for t in column:
        yield t.as_buffer().to_pybytes() if t.is_valid else b""


def _count_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of a batch each key stands (kind 0), and how often each whole text comes (kind 1)."""
    for batch in batches:
        seen: tuple[list[bytes], list[bytes]] = [], []
        for text in _texts(batch.column(0)):
            seen[0].extend(map(_digest, set(line_keys(text)) - {b""}))
            seen[1].append(_digest(text))
        for kind, digests in enumerate(seen):
            if digests:
                distinct, counts = np.unique(np.frombuffer(b"".join(digests), dtype=_KEY), return_counts=True)
                columns = (distinct["hi"].view("<i8"), distinct["lo"].view("<i8"), np.full(len(counts), kind, np.int8), counts.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hi", "lo", "kind", "n_docs"])


def _rebuild(dropped):
    """Batches (id, text, ...) to (doc_id, n_lines, n_dropped, kept_text); ``dropped(batch)`` tells each row's bad keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            texts = list(_texts(batch.column(1)))
            for text, bad in zip(texts, dropped(batch, texts), strict=True):
                lines = text.split(b"\n")
                total.append(len(lines))
                if bad:
                    lines = [x for x, key in zip(lines, line_keys(text), strict=True) if key not in bad]
                gone.append(total[-1] - len(lines))
                kept.append((b"\n".join(lines)).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_text"])

    return run


_OUT = "doc_id long, n_lines long, n_dropped long, kept_text string"


class Filters:
    """The cuckoo filters of all shards, and the exact frequent keys behind them."""

    def __init__(self, shards: dict[int, np.ndarray], n_shards: int, exact: np.ndarray | None) -> None:
        self.filters = {s: CuckooFilter(0, t) for s, t in shards.items()}
        self.n_shards, self.exact = n_shards, exact

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=bool)
        shard = (keys["hi"] % np.uint64(self.n_shards)).astype(np.int64)
        for s in np.unique(shard).tolist():
            if s in self.filters:
                at = np.flatnonzero(shard == s)
                out[at] = self.filters[s].contains(keys["lo"][at])
        return out

    def frequent(self, keys: np.ndarray) -> np.ndarray:
        """Exact answers: the filters first, then the table for what they let through."""
        out = np.zeros(len(keys), dtype=bool)
        at = np.flatnonzero(self.maybe(keys))
        if len(at) and len(self.exact):
            place = np.minimum(np.searchsorted(self.exact, keys[at]), len(self.exact) - 1)
            out[at] = self.exact[place] == keys[at]
        return out


_COUNTS = "hi long, lo long, kind byte, n_docs long, was_frequent boolean, frequent boolean"


class LineDedupIndex:
    """An incremental index in ``folder``: a version of the exact counts and of the filters for each update.

    The folder holds the whole state, so it can be opened again; an update that was interrupted is no version.  One
    writer at a time.  The version before the newest is kept, older ones are removed.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, threshold: int = 10) -> None:
        self.spark, self.folder, self.threshold = spark, folder or shared_dir(spark, "lines"), threshold
        self.version, self.n_shards = 0, 1
        store, root = pyarrow.fs.FileSystem.from_uri(self.folder)
        if store.get_file_info(root).type == pyarrow.fs.FileType.Directory:
            marks = [f.base_name.split("-")[1:] for f in store.get_file_info(pyarrow.fs.FileSelector(root)) if f.base_name.startswith("version-")]
            for version, shards, threshold in (tuple(map(int, m)) for m in marks):
                if version > self.version:
                    self.version, self.n_shards, self.threshold = version, shards, threshold

    def _table(self, what: str, version: int | None = None) -> str:
        return f"{self.folder}/{what}-{self.version if version is None else version:06d}"

    def _merged(self, version: int | None = None) -> DataFrame:
        return self.spark.read.schema(_COUNTS).parquet(self._table("counts", version))

    def counts(self) -> DataFrame:
        """hi, lo, n_docs, frequent: the exact reference counts of the line keys."""
        return self._merged().where("kind = 0 and n_docs > 0").select("hi", "lo", "n_docs", "frequent")

    def insert(self, docs: DataFrame, text_col: str = "text") -> None:
        """Adds the documents; each row is one document."""
        self._update(docs, 1, text_col)

    def delete(self, docs: DataFrame, text_col: str = "text") -> None:
        """Takes out documents that were inserted, by their texts; ValueError, and no change, if one of them wasn't."""
        self._update(docs, -1, text_col)

    def _update(self, docs: DataFrame, sign: int, text_col: str) -> None:
        new = self.version + 1
        was = docs.select(F.col(text_col).alias("text")).mapInArrow(_count_lines, "hi long, lo long, kind byte, n_docs long").select("hi", "lo", "kind", F.col("n_docs") * sign, F.lit(False).alias("frequent"))
        if self.version:
            was = was.unionAll(self._merged().where("n_docs > 0").select("hi", "lo", "kind", "n_docs", "frequent"))
        merged = was.toDF("hi", "lo", "kind", "n_docs", "frequent").groupBy("hi", "lo", "kind").agg(F.sum("n_docs").alias("n_docs"), F.max("frequent").alias("was_frequent")).where("n_docs <> 0 or was_frequent")
        merged = merged.withColumn("frequent", (F.col("kind") == 0) & (F.col("n_docs") >= self.threshold))
        merged.write.mode("overwrite").parquet(self._table("counts", new))
        if sign < 0 and not self._merged(new).where("n_docs < 0").isEmpty():
            raise ValueError("a document to delete was never inserted, or less often")
        shards = self._filters(new)
        self.n_shards, self.version = shards, new
        store, root = pyarrow.fs.FileSystem.from_uri(self.folder)
        store.open_output_stream(f"{root}/version-{new:06d}-{shards}-{self.threshold}").close()
        for what in ("counts", "filters"):
            remove(self._table(what, new - 2))

    def _filters(self, new: int) -> int:
        """Writes the filters of a version and returns the number of shards: keys that crossed the threshold go in or out."""
        frequent = self._merged(new).where("frequent")
        shards = max(1, -(-frequent.count() // SHARD_KEYS))
        n, rebuilt = self.n_shards, not self.version
        if shards > n:
            n, rebuilt = 1 << (shards - 1).bit_length(), True
        while True:
            changed = frequent if rebuilt else self._merged(new).where("frequent <> was_frequent")
            try:
                self._build(changed.select("hi", "lo", "frequent"), n, rebuilt, new)
                return n
            except PythonException as e:
                if _OVERFULL not in str(e):
                    raise
                n, rebuilt = 2 * n, True  # all frequent keys go to new filters of half as many keys

    def _build(self, changed: DataFrame, n: int, rebuilt: bool, new: int) -> None:
        capacity = 2 * SHARD_KEYS
        shard = F.pmod(F.pmod("hi", F.lit(n)) + F.lit(n), F.lit(n)).cast("int")  # n is a power of two
        keys = changed.select(shard.alias("shard"), "lo", "frequent")

        def build(group: tuple, keys_pdf, old_pdf):
            import pandas as pd

            held = old_pdf["table"].iloc[0] if len(old_pdf) else None
            table = None if held is None else np.frombuffer(held, np.uint16).reshape(-1, CuckooFilter.SLOTS).copy()
            cuckoo = CuckooFilter(capacity, table)
            going, coming = (keys_pdf["lo"][keys_pdf["frequent"] == x].to_numpy(np.int64).view(np.uint64) for x in (False, True))
            cuckoo.remove(going)
            if not cuckoo.add(coming):
                raise ValueError(_OVERFULL)
            return pd.DataFrame({"shard": [group[0]], "table": [cuckoo.table.tobytes()]})

        old = self.spark.createDataFrame([], "shard int, table binary") if rebuilt else self.spark.read.schema("table binary, shard int").parquet(self._table("filters"))
        built = keys.groupBy("shard").cogroup(old.groupBy("shard")).applyInPandas(build, "shard int, table binary")
        built.write.mode("overwrite").partitionBy("shard").parquet(self._table("filters", new))

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per input row: doc_id, n_lines, n_dropped, kept_text.

        Lines whose key has a code point and stands in ``threshold`` or more documents go, in every document; the others
        stay, joined by newlines.  A null or empty text is one empty line, which stays.  Rows that repeat an id are
        documents of their own, and a line that repeats in one document counts once for it.
        """
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        frequent = self.counts().where("frequent").select("hi", "lo")
        if frequent.count() > SENT_KEYS:
            return self._apply_joined(rows, frequent)
        pairs = frequent.toArrow()  # 16 bytes a key
        exact = np.zeros(pairs.num_rows, dtype=_KEY)
        for name in ("hi", "lo"):
            exact[name] = pairs[name].to_numpy().view("<u8")
        exact.sort()
        tables = self.spark.read.schema("table binary, shard int").parquet(self._table("filters")).collect()
        filters = Filters({r.shard: np.frombuffer(bytes(r.table), np.uint16).reshape(-1, CuckooFilter.SLOTS) for r in tables}, self.n_shards, exact)
        sent = self.spark.sparkContext.broadcast(filters)

        def dropped(batch: pa.RecordBatch, texts: list[bytes]) -> list[set[bytes]]:
            keys = {k for text in texts for k in line_keys(text)} - {b""}
            keys = list(keys)
            found = sent.value.frequent(np.frombuffer(b"".join(map(_digest, keys)), dtype=_KEY)) if keys else []
            bad = {k for k, hit in zip(keys, found, strict=True) if hit}
            return [bad] * len(texts)

        return rows.mapInArrow(_rebuild(dropped), _OUT)

    def _apply_joined(self, rows: DataFrame, frequent: DataFrame) -> DataFrame:
        """The same with joins: keys meet their shard's filter, survivors the exact table, and the result the texts."""
        n = self.n_shards
        rows = rows.withColumn("text_key", F.xxhash64("text"))

        def keys_of(batches):
            for batch in batches:
                out: list[bytes] = []
                owner: list[int] = []
                for i, text in enumerate(_texts(batch.column(1))):
                    keys = set(line_keys(text)) - {b""}
                    out += map(_digest, keys)
                    owner += [i] * len(keys)
                keys = np.frombuffer(b"".join(out), dtype=_KEY)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(keys["hi"].view("<i8")), pa.array(keys["lo"].view("<i8")), pa.array((keys["hi"] % np.uint64(n)).astype(np.int32))], names=["text_key", "hi", "lo", "shard"])

        folder = self._table("filters")

        def screen(batches):
            store, root = pyarrow.fs.FileSystem.from_uri(folder)
            held: dict[int, CuckooFilter | None] = {}
            for batch in batches:
                keep = np.zeros(batch.num_rows, dtype=bool)
                shard, lo = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
                for s in np.unique(shard).tolist():
                    if s not in held:
                        tables = pyarrow.dataset.dataset(root, filesystem=store, format="parquet", partitioning="hive").to_table(["table"], filter=pyarrow.dataset.field("shard") == s)["table"]
                        held[s] = CuckooFilter(0, np.frombuffer(tables[0].as_py(), np.uint16).reshape(-1, CuckooFilter.SLOTS)) if len(tables) else None
                    at = np.flatnonzero(shard == s)
                    if held[s] is not None:
                        keep[at] = held[s].contains(lo[at])
                yield batch.filter(pa.array(keep))

        scratch = Scratch(self.spark, "line-keys")
        keys = scratch.write(rows.select("text_key", "text").mapInArrow(keys_of, "text_key long, hi long, lo long, shard int"), "keys")
        #: Each distinct key meets its shard's filter once; a task needs the filters of its shards only.
        maybe = keys.select("shard", "lo", "hi").distinct().repartition("shard", F.pmod("lo", F.lit(8))).mapInArrow(screen, "shard int, lo long, hi long")
        counted = self.counts().where("frequent").select("hi", "lo", "n_docs")
        found = maybe.join(counted, ["hi", "lo"]).select(F.struct("hi", "lo").alias("key"), "n_docs")
        found = scratch.write(found, "found")
        bad = join_counted(keys.select(F.struct("hi", "lo").alias("key"), "text_key"), found, "key", "n_docs")
        bad = scratch.write(bad.groupBy("text_key").agg(F.collect_set("key").alias("bad")), "bad")

        def dropped(batch, texts):
            for text, bad in zip(texts, batch.column(2).to_pylist(), strict=True):
                held = {np.array([(b["hi"] & (2**64 - 1), b["lo"] & (2**64 - 1))], dtype=_KEY).tobytes() for b in bad or ()}
                yield {k for k in set(line_keys(text)) - {b""} if _digest(k) in held} if held else set()

        return rows.join(bad, "text_key", "left").select("doc_id", "text", "bad").mapInArrow(_rebuild(dropped), _OUT)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index = LineDedupIndex(spark, threshold=10)
    index.insert(docs)
    return index.apply(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
