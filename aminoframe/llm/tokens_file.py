"""Token-id files: independent zstandard frames with a trailing seek table and a checksum for each frame.

Layout of a file (integers little-endian, as in zstandard's seekable format):

* data frames: each an independent zstandard frame over the ids of whole documents, 4 bytes an id; a longer document goes
  on in the frames after it;
* one more frame over the document table: for each document its id, null flag, frame, first id in the frame and count;
* a skippable frame (magic 0x184D2A5E) with the seek table: compressed size, decompressed size and checksum of each
  frame, the document table's included; then the number of frames, a descriptor byte and the magic 0x8F92EAB1.

A checksum is the low 32 bits of the XXH64 of the decompressed bytes.  A reader takes the table from the file's end and
decompresses only the frames of the documents asked for.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .scratch import shared_dir, written
from .units import Units, pieces, safe_gaps

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_IDS = 1 << 16
BATCH_BYTES = 4 << 20
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("first", "<u4"), ("count", "<u8")])


class Writer:
    """Writes one file to a binary stream; documents are begun in order and their ids come in one or more pieces."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = 1) -> None:
        self.out, self.frame_ids, self.level = out, frame_ids, level
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[list[int]] = []
        self.held: list[bytes] = []
        self.n_held = self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes, goes_on: bool = False) -> None:
        """``ids``: 4 bytes an id; ``goes_on``: more of the document that was begun last."""
        n = len(ids) // 4
        if self.n_held and self.n_held + n > self.frame_ids:
            self._flush()
        if not goes_on:
            self.docs.append([doc_id or 0, doc_id is None, len(self.frames), self.n_held, 0])
        self.docs[-1][4] += n
        self.held.append(ids)
        self.n_held += n
        self.n_ids += n

    def _frame(self, raw: bytes) -> None:
        packed = zstandard.ZstdCompressor(level=self.level).compress(raw)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.out.write(packed)

    def _flush(self) -> None:
        if self.held:
            self._frame(b"".join(self.held))
        self.held, self.n_held = [], 0

    def close(self) -> None:
        self._flush()
        self._frame(np.array([tuple(d) for d in self.docs], dtype=_DOC).tobytes())
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class Reader:
    """Reads documents of one file from a seekable binary stream."""

    def __init__(self, source) -> None:
        self.source = source
        source.seek(0, io.SEEK_END)
        size = source.tell()
        n, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or descriptor != 0x80:
            raise ValueError("no seek table at the end of the file")
        self.table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), dtype="<u4").reshape(n, 3)
        self.offsets = np.r_[0, np.cumsum(self.table[:, 0], dtype=np.int64)]
        self.docs = np.frombuffer(self.frame(n - 1), dtype=_DOC)
        self.held: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def frame(self, i: int) -> bytes:
        """The checked bytes of frame ``i``; nothing else is read."""
        packed, size, check = (int(x) for x in self.table[i])
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[i]), packed), max_output_size=size) if size else b""
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return raw

    def parts(self, row: int) -> Iterator[np.ndarray]:
        """The ids of the ``row``-th document of the file, a frame at a time."""
        d = self.docs[row]
        frame, first, left = int(d["frame"]), int(d["first"]), int(d["count"])
        while left:
            if self.held[0] != frame:
                self.held = (frame, self.frame(frame))
            part = np.frombuffer(self.held[1], dtype="<u4", offset=4 * first)[:left]
            yield part
            frame, first, left = frame + 1, 0, left - len(part)

    def ids(self, row: int) -> np.ndarray:
        """The ids of the ``row``-th document of the file."""
        return np.concatenate([np.zeros(0, "<u4"), *self.parts(row)])

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of each row with this doc_id."""
        return [self.ids(i) for i in np.flatnonzero((self.docs["doc_id"] == doc_id) & (self.docs["null"] == 0))]


def _joints(data: np.ndarray, offsets: np.ndarray | None = None) -> np.ndarray:
    """Places before which a text may be parted: single spaces, and single newlines on both sides."""
    lines = safe_gaps(data, 10, offsets)
    return np.sort(np.concatenate([safe_gaps(data, 32, offsets), lines, lines + 1]), kind="stable")


#: A word, with the space before it or without, of characters that are surely no white space.
_PLAIN_UNIT = re.compile(rb" ?(?:[!-~]|[\xc3-\xdf][\x80-\xbf]|[\xe4-\xed][\x80-\xbf]{2})+")


#: What a byte is to the vocabulary's pattern: 1 white space, 2 letter (also U+00C0-024F but two signs), 3 digit, 4 other sign,
#: 9 unsure, like the apostrophe.
_KIND = np.full(256, 9, dtype=np.uint8)
_KIND[33:127] = 4
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[48:58] = 3
_KIND[65:91] = _KIND[97:123] = _KIND[128:192] = _KIND[0xC3:0xCA] = 2
_KIND[ord("'")] = 9


def _inner_joints(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Where parts that begin at ``start`` may be parted further: where letters, digits and other signs meet.

    Only in parts without unsure characters, special tokens (which begin with <|) and white space but the first.
    """
    kind = _KIND[data]
    odd = kind == 9
    odd[:-1] |= ((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))) | ((data[:-1] == 60) & (data[1:] == 124))
    gap = kind == 1
    begins = np.zeros(len(data), dtype=bool)
    begins[start] = True
    odd |= gap & ~begins
    changes = np.zeros(len(data), dtype=bool)
    changes[1:] = (kind[1:] != kind[:-1]) & ~gap[:-1]
    changes &= ~begins
    at = np.flatnonzero(changes)
    part = np.searchsorted(start, at, side="right") - 1
    return at[~np.logical_or.reduceat(odd, start)[part]] if len(at) else at


class Encoder:
    """ids of a byte-level vocabulary of the tokenizers library, special tokens as it handles them by default.

    The vocabulary's pattern always parts a text before a single space, and before and after a single newline, between
    characters that are no white space, and where plain letters, digits and signs meet; no merge reaches over that, and
    no special token holds one.  Each distinct part of a batch is encoded once by the library; odd spacing and signs
    stay inside a part.
    """

    def __init__(self, path: str, entries: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or not {" ", "\n"}.isdisjoint(t.content) or t.content[:2] != "<|" for t in added):
            raise ValueError("a special token reaches over white space, so texts can't be parted there")
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.units = Units(entries)

    def _compute(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Plain units are encoded as the lines of one text, the others one by one."""
        plain = np.fromiter((_PLAIN_UNIT.fullmatch(u) is not None for u in units), bool, len(units))
        count = np.zeros(len(units), np.int64)
        parts = [np.zeros(0, np.uint32)]
        if plain.any():
            (lines,) = self.tokenizer.encode_batch_fast([b"\n".join([u for u, p in zip(units, plain.tolist(), strict=True) if p]).decode()], add_special_tokens=False)
            ids = np.array(lines.ids, dtype=np.uint32)
            ends = np.r_[np.flatnonzero(ids == self.newline), len(ids)]
            count[plain] = np.diff(np.r_[-1, ends]) - 1
            parts.append(ids[ids != self.newline])
        odd = np.flatnonzero(~plain)
        found = self.tokenizer.encode_batch_fast([units[i].decode() for i in odd.tolist()], add_special_tokens=False)
        parts += [np.array(e.ids, dtype=np.uint32) for e in found]
        count[odd] = [len(p) for p in parts[len(parts) - len(found) :]]
        order = np.r_[np.flatnonzero(plain), odd]
        begin = np.zeros(len(units), np.int64)
        begin[order] = np.cumsum(count[order]) - count[order]
        return np.concatenate(parts), begin, count

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts between neighbouring offsets, one text after another, and each text's number of ids."""
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[_joints(data, offsets)] = begins[offsets] = True
        start = np.flatnonzero(begins[:-1])
        cuts = np.concatenate([start, _inner_joints(data, start)])
        ids, count, owners = self.units.values(data, cuts, offsets, self._compute)
        return ids, np.diff(np.r_[0, np.cumsum(count)][owners])


_ENCODERS: dict[str, Encoder] = {}


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = Encoder(tokenizer)
        encoder, end = _ENCODERS[tokenizer], struct.pack("<I", end_id)
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        writer, stream, path, first = None, None, None, None
        for batch in batches:
            names, goes_on = batch.column(0).to_pylist(), False
            for lo, data, offsets, more in pieces(batch.column(1), BATCH_BYTES, _joints):
                ids, count = encoder.encode(data, offsets)
                cuts = np.r_[0, np.cumsum(count)].tolist()
                for d, doc_id in enumerate(names[lo : lo + len(count)]):
                    if writer is None:
                        # A name of its own for each attempt: a lost or repeated task leaves a file that no manifest names.
                        path, first = f"{uuid.uuid4().hex}.tok.zst", doc_id
                        store.create_dir(root, recursive=True)
                        stream = store.open_output_stream(f"{root}/{path}", compression=None)
                        writer = Writer(stream)
                    writer.add(doc_id, ids[cuts[d] : cuts[d + 1]].astype("<u4").tobytes() + (b"" if more else end), goes_on)
                goes_on = more
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([first], pa.int64()), pa.array([len(writer.docs)], pa.int64()), pa.array([writer.n_ids], pa.int64())], names=["path", "first_id", "n_docs", "n_ids"])

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, appends ``end_id`` and writes the ids in ascending id order; returns the manifest.

    Manifest rows: folder, path, part (place in the order), first_id, n_docs, n_ids.  One file for each range of ids.
    Null texts count as empty and have the end id alone; null ids come first; rows that repeat an id stand together in
    any order.  An empty table makes no file.
    """
    folder = folder or shared_dir(docs.sparkSession, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    files = ordered.mapInArrow(_write(folder, tokenizer, end_id), "path string, first_id long, n_docs long, n_ids long")
    manifest = files.select(F.lit(folder).alias("folder"), "path", F.spark_partition_id().alias("part"), "first_id", "n_docs", "n_ids")
    return written(manifest, "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            store, root = pyarrow.fs.FileSystem.from_uri(row["folder"])
            with store.open_input_file(f"{root}/{row['path']}") as source:
                reader, start = Reader(source), row["before"]
                for lo in range(0, len(reader.docs), 4096):
                    part = reader.docs[lo : lo + 4096]
                    crc = [reduce(lambda c, ids: zlib.crc32(ids.tobytes(), c), reader.parts(i), 0) for i in range(lo, lo + len(part))]
                    count = part["count"].astype(np.int64)
                    starts = start + np.cumsum(count) - count
                    start += int(count.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"].astype(np.int64), mask=part["null"] > 0), pa.array(starts), pa.array(count), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32; one task a file."""
    rows = sorted((r.part, r.folder, r.path, r.n_ids) for r in manifest.collect())  # a row a file
    before = np.r_[0, np.cumsum([r[3] for r in rows])].tolist()
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.createDataFrame([(folder, path, n) for (_, folder, path, _), n in zip(rows, before[:-1], strict=True)], "folder string, path string, before long")
    return files.repartition(len(rows), F.monotonically_increasing_id()).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids of the documents in ``wanted`` only; a file's tasks decompress no other frames.

    Files are chosen by their ranges of ids; ``wanted`` may be of any size, as it is grouped by file.
    """
    rows = sorted((r.part, r.folder, r.path, r.first_id) for r in manifest.collect())
    firsts = [(-(1 << 63) if r[3] is None else r[3]) for r in rows]
    spark = manifest.sparkSession
    files = spark.createDataFrame([(i, r[1], r[2]) for i, r in enumerate(rows)], "file int, folder string, path string")

    def place(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lo, hi = np.searchsorted(firsts, ids, side="left") - 1, np.searchsorted(firsts, ids, side="right") - 1
            lo = np.maximum(lo, 0)
            count = np.maximum(hi - lo + 1, 0)
            which = np.repeat(np.arange(len(ids)), count)
            at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + lo[which]
            yield pa.RecordBatch.from_arrays([pa.array(ids[which]), pa.array(at.astype(np.int32))], names=["doc_id", "file"])

    def fetch(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, root = pyarrow.fs.FileSystem.from_uri(row["folder"])
                with store.open_input_file(f"{root}/{row['path']}") as source:
                    reader = Reader(source)
                    found = [(d, ids.tolist()) for d in sorted(row["ids"]) for ids in reader.find(d)]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([i for _, i in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    asked = wanted.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct().mapInArrow(place, "doc_id long, file int")
    #: 1,000 documents of a file at a time.
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(64))).groupBy("file", "block").agg(F.collect_list("doc_id").alias("ids"))
    return blocks.join(files, "file").select("folder", "path", "ids").mapInArrow(fetch, "doc_id long, ids array<long>")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_token_files(spark, write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json")))
