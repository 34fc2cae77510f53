"""Benchmark decontamination with suffix arrays of the training texts.

The training texts are indexed in shards of bounded size: a shard's suffix array holds all its word suffixes in order.
Every suffix of every test item is looked up in every shard by binary search, which gives all places where its first
words occur verbatim; from there the longest match is followed word by word, with its location.

Words are told apart by their bytes, never by a hash.  Test items lie in block files in the shared folder, cut so that
neither many items nor a long one makes a block large.  A shard's array is built once, and a task searches the blocks
one after another, so nothing of the benchmark passes through the driver.  A search is a pass over the texts, with no
shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import shared_dir
from .words import ALNUM_MASK, CHUNK_BYTES, Words, words_of

BLOCK_BYTES = 8 << 20
#: Words of a test item that lie in one row of a block file, besides the overlap.
ITEM_WORDS = 1 << 16
_MATCHES = "array<struct<start:int,length:int,item_id:string,item_start:int>>"
_MATCH_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("item_id", pa.string()), ("item_start", pa.int32())]))


def suffix_array(numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in order; ``numbers`` are positive, texts lie between neighbouring ``first``.

    A suffix ends with its text.  Ranks by the first 1, 2, 4, ... words are refined where they are still shared.
    """
    n = len(numbers)
    order = np.argsort(numbers, kind="stable")
    stop = np.repeat(first[1:], np.diff(first))
    rank = np.empty(n, dtype=np.int64)
    key, width = numbers[order], 1
    places, array = np.arange(n), order.copy()
    while len(places):
        head = np.r_[True, key[1:] != key[:-1]]
        group = np.maximum.accumulate(np.where(head, np.arange(len(places)), 0))
        rank[array[places]] = places[group] + 1
        shared = ~head | ~np.r_[head[1:], True]
        if width > 1:
            shared &= (key & 0xFFFFFFFF) > 0  # suffixes that have ended alike stay as they are
        places = places[shared]
        at = array[places]
        following = at + width
        inside = following < stop[at]
        second = np.where(inside, rank[np.minimum(following, n - 1)], 0)
        key = rank[at] << 32 | second
        order = np.argsort(key, kind="stable")
        array[places], key = at[order], key[order]
        width *= 2
    return array


@dataclass
class Block:
    """Test items as numbers of a vocabulary, and their windows: ``window`` words, or the whole of a shorter item."""

    names: list[str]
    vocabulary: pa.Array
    numbers: np.ndarray
    at: np.ndarray  # first word of each window in numbers
    length: np.ndarray
    content: np.ndarray  # windows of the same words have the same number
    leader: np.ndarray  # one window of each content
    of_content: list[dict[int, list[int]]]  # by content: the rows that have it, and at which windows
    head: np.ndarray  # each row's first window
    offset: np.ndarray  # words of the item before the row


def make_block(rows: list[tuple[str, int, bool, bytes]], window: int) -> Block | None:
    """From (item, words before, whether these are all its words, words joined by a space)."""
    (w,) = words_of(pa.array([t for *_, t in rows], pa.large_binary()).cast(pa.large_string()), ALNUM_MASK, fold=True, chunk_bytes=1 << 62)
    count = np.diff(w.first)
    n_windows = np.where(count >= window, count - window + 1, [int(all_ and n > 0) for (_, _, all_, _), n in zip(rows, count.tolist(), strict=True)])
    if not n_windows.sum():
        return None
    row = np.repeat(np.arange(len(rows)), n_windows)
    head = np.cumsum(n_windows) - n_windows
    at = w.first[row] + np.arange(len(row)) - head[row]
    length = np.minimum(count[row], window)
    picked = np.where(np.arange(window) < length[:, None], w.number[np.minimum(at[:, None] + np.arange(window), len(w.number) - 1)], -1).astype(np.int32)
    _, leader, content = np.unique(np.ascontiguousarray(picked).view(f"V{4 * window}").ravel(), return_index=True, return_inverse=True)
    of_content: list[dict[int, list[int]]] = [{} for _ in leader]
    for i, (c, r) in enumerate(zip(content.tolist(), row.tolist(), strict=True)):
        of_content[c].setdefault(r, []).append(i)
    return Block([name for name, *_ in rows], w.spelling, w.number, at, length, content, leader, of_content, np.r_[head, len(row)], np.array([o for _, o, *_ in rows]))


class Shard:
    """The words of some texts and their suffix array."""

    def __init__(self, w: Words) -> None:
        self.spelling, self.numbers = w.spelling, w.number.astype(np.int64) + 1
        self.stop = np.repeat(w.first[1:], np.diff(w.first))
        self.array = suffix_array(self.numbers, w.first)

    def _compare(self, queries: np.ndarray, length: np.ndarray, at: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: how the suffix at ``at`` stands to each query, as far as the query goes."""
        sign = np.zeros(len(at), dtype=np.int8)
        for i in range(queries.shape[1]):
            open_ = np.flatnonzero((sign == 0) & (length > i))
            if not len(open_):
                break
            place = at[open_] + i
            mine = np.where(place < self.stop[at[open_]], self.numbers[np.minimum(place, len(self.numbers) - 1)], 0)
            sign[open_] = np.sign(mine - queries[open_, i])
        return sign

    def search(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of a window's content, low, high): the part of the array that begins with the window, if there is one."""
        known = pc.index_in(block.vocabulary, value_set=self.spelling).fill_null(-1).to_numpy().astype(np.int64) + 1
        window = int(block.length.max())
        numbers = known[block.numbers]
        missing = np.r_[0, np.cumsum(numbers == 0)]
        begin, length = block.at[block.leader], block.length[block.leader]
        which = np.flatnonzero(missing[begin + length] == missing[begin])  # with a word that the shard lacks there is none
        begin, length = begin[which], length[which]
        queries = numbers[np.minimum(begin[:, None] + np.arange(window), len(numbers) - 1)]
        bounds = []
        for past in (0, 1):  # the first suffix that isn't below the query, the first that is above it
            low, high = np.zeros(len(which), np.int64), np.full(len(which), len(self.array), np.int64)
            while (busy := np.flatnonzero(low < high)).size:
                middle = (low[busy] + high[busy]) >> 1
                below = self._compare(queries[busy], length[busy], self.array[middle]) < past
                low[busy] = np.where(below, middle + 1, low[busy])
                high[busy] = np.where(below, high[busy], middle)
            bounds.append(low)
        found = bounds[0] < bounds[1]
        return which[found], bounds[0][found], bounds[1][found]

    def places(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(first word, content) of all occurrences of the block's windows, in order of words."""
        content, low, high = self.search(block)
        count = high - low
        which = np.repeat(np.arange(len(count)), count)
        at = self.array[low[which] + np.arange(len(which)) - (np.cumsum(count) - count)[which]]
        order = np.argsort(at, kind="stable")
        return at[order], content[which[order]]


@lru_cache(maxsize=4)
def _block(path: str, window: int) -> Block | None:
    store, root = pyarrow.fs.FileSystem.from_uri(path)
    with store.open_input_file(root) as source:
        rows = pyarrow.parquet.read_table(source).to_pylist()
    return make_block(sorted((r["item_id"], r["before"], r["whole"], r["words"]) for r in rows), window) if rows else None


@lru_cache(maxsize=4)
def _files(folder: str) -> list[str]:
    store, root = pyarrow.fs.FileSystem.from_uri(folder)
    scheme = folder[: len(folder) - len(folder.split("://", 1)[-1])]
    prefix = scheme + folder.split("://", 1)[-1][: -len(root)] if scheme else ""
    found = store.get_file_info(pyarrow.fs.FileSelector(root))
    return sorted(prefix + f.path for f in found if f.path.endswith(".parquet"))


def _runs(block: Block, places: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(start, length, row of the block, word of the row) of one text's matches, from its (place, content) in order.

    A match goes on while the next place has the item's next window; a new one takes the longest that the item has.
    """
    at_place = dict(places)
    going: dict[int, tuple[int, int]] = {}  # row: window that would go on, at which place
    for place, content in places:
        for row, windows in block.of_content[content].items():
            was = going.get(row)
            if was and was[1] == place and was[0] < block.head[row + 1] and block.content[was[0]] == content:
                going[row] = was[0] + 1, place + 1
                continue
            best, best_size = windows[0], 0
            for q in windows:
                most = int(block.head[row + 1]) - q
                if most <= best_size:
                    break
                size = 1
                while size < most and at_place.get(place + size) == block.content[q + size]:
                    size += 1
                if size > best_size:
                    best, best_size = q, size
            going[row] = best + 1, place + 1
            yield place, best_size - 1 + int(block.length[best]), row, int(block.at[best] - block.at[block.head[row]])


def _joined(found: list[dict]) -> list[dict]:
    """Matches of one text by place; parts of one longer match (same item, same distance) become one."""
    out: list[dict] = []
    for m in sorted(found, key=lambda m: (m["item_id"], m["item_start"] - m["start"], m["start"])):
        last = out[-1] if out else None
        if last and last["item_id"] == m["item_id"] and last["item_start"] - last["start"] == m["item_start"] - m["start"] and m["start"] <= last["start"] + last["length"]:
            last["length"] = max(last["length"], m["start"] + m["length"] - last["start"])
        else:
            out.append(dict(m))
    return sorted(out, key=lambda m: (m["start"], -m["length"], m["item_id"], m["item_start"]))


def _hits(w: Words, blocks: list[Block], window: int) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
    """(block, first words, contents) of the places in a shard; those that the piece before has seen are left out."""
    if not len(w.number):
        return
    shard = Shard(w)
    for block in blocks:
        at, content = shard.places(block)
        if w.again:
            fresh = at + block.length[block.leader[content]] > w.again
            at, content = at[fresh], content[fresh]
        if len(at):
            yield block, at, content


def _blocks(folder: str, window: int) -> Iterator[Block]:
    for path in _files(folder):
        block = _block(path, window)
        if block is not None:
            yield block


def _find(folder: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for w in words_of(batch.column(1), ALNUM_MASK, fold=True, overlap=window - 1):
                n_words[w.rows()] += np.diff(w.first) - w.again
                for block, at, content in _hits(w, _blocks(folder, window), window):
                    doc = np.searchsorted(w.first, at, side="right") - 1
                    cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True])
                    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                        d = int(doc[lo])
                        places: dict[int, list] = {}
                        for a, c in zip((at[lo:hi] - w.first[d]).tolist(), content[lo:hi].tolist(), strict=True):
                            places.setdefault(int(block.length[block.leader[c]]), []).append((a, c))
                        for same in places.values():
                            for start, length, row, item_start in _runs(block, same):
                                found[w.lo + d].append({"start": start + w.base, "length": length, "item_id": block.names[row], "item_start": item_start + int(block.offset[row])})
            matches = [_joined(f) if len(f) > 1 else f for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(matches, _MATCH_TYPE)], names=["doc_id", "n_words", "matches"])

    return run


def _cut_items(window: int):
    """Items as rows of at most ITEM_WORDS words and the window's overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            out: list[tuple[str, int, bool, bytes]] = []
            for w in words_of(batch.column(1), ALNUM_MASK, fold=True, overlap=window - 1):
                for d in range(len(w.first) - 1):
                    lo, hi = int(w.first[d]), int(w.first[d + 1])
                    for a in range(lo, max(lo + 1, hi - window + 1), ITEM_WORDS):
                        b = min(hi, a + ITEM_WORDS + window - 1)
                        if a < b:
                            text = b" ".join(w.data[s:e].tobytes() for s, e in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True))
                            out.append((names[w.lo + d], w.base + a - lo, (a, b) == (lo, hi) and not w.base and not w.more, text))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.string(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["item_id", "before", "whole", "words"])

    return run


def write_blocks(benchmark: DataFrame, window: int, block_bytes: int = BLOCK_BYTES, item_col: str = "item_id", text_col: str = "text") -> str:
    """Writes the test items to block files of about ``block_bytes`` in the shared folder, which is returned."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = items.mapInArrow(_cut_items(window), "item_id string, before long, whole boolean, words binary")
    folder = shared_dir(benchmark.sparkSession, "items") + "/blocks"
    rows.repartition(max(1, -(-int(size) // block_bytes)), "item_id", "before", "words").write.parquet(folder)
    return folder


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, matches (start, length, item_id, item_start), by place, longest first.

    A-Z are lower-cased; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A match is a run of words that a document
    shares with an item, followed as far as it goes, of at least ``window`` words, or the whole of a shorter item.  The
    matches cover every occurrence of every window.  Null and empty texts, on either side, have no words and match
    nothing; a null item_id is named by an empty string.  Rows that repeat an id are searched one by one, repeated items
    once.  Other columns are ignored.  Texts longer than a shard are searched in overlapping pieces.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    folder = write_blocks(benchmark, window, block_bytes, item_col, item_text_col)
    return texts.mapInArrow(_find(folder, window), f"doc_id long, n_words long, matches {_MATCHES}")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    empty = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        n_hit, n_items, sha = [], [], []
        for found in batch.column(2).to_pylist():
            if not found:
                n_hit.append(0), n_items.append(0), sha.append(empty)
                continue
            hit, end = 0, 0
            for m in found:
                hit += max(0, m["start"] + m["length"] - max(end, m["start"]))
                end = max(end, m["start"] + m["length"])
            items = sorted({m["item_id"] for m in found})
            n_hit.append(hit), n_items.append(len(items)), sha.append(hashlib.sha256(",".join(items).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` (columns unchanged) in which no window of any benchmark item occurs.

    A null doc_id or text is a document like any other, which stays.  One pass over the texts.
    """
    folder = write_blocks(benchmark, window, block_bytes)
    return docs.mapInArrow(_clean(folder, window, docs.columns.index("text")), docs.schema)


def _clean(folder: str, window: int, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for w in words_of(batch.column(column), ALNUM_MASK, fold=True, overlap=window - 1):
                for _, at, _ in _hits(w, _blocks(folder, window), window):
                    keep[w.lo + np.searchsorted(w.first, at, side="right") - 1] = False
            yield batch.filter(pa.array(keep))

    return run


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(docs, benchmark).mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
    return found.withColumn("contaminated", F.col("n_hit") > 0)
