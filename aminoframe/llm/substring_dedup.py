"""Substring deduplication by relative Lempel-Ziv parsing against every indexed reference block.

The reference is every run of words where it stands first (smallest document id).  It is indexed by *blocks* that the
content cuts: the 35 phrases of 16 words in a 50-word window are hashed and the smallest is the window's anchor;
consecutive windows with one anchor form a block, so equal windows always have the same anchor.

1. A document's block that is found whole in an earlier document refers to it.  Where blocks with one anchor differ,
   their windows are looked up one by one.  This tells for each window of a document its reference, if it has one.
2. The words of the reference blocks are fetched, and the document is parsed greedily from the left: from the first
   window that no factor holds, the longest run of words that goes on alike in its reference is a factor.
3. Factors of a window's length or more are the duplicate spans.  At a factor's end, the windows that reach over it are
   looked at in turn, so a copy that goes on in another document is found with the words before the boundary.

Hashes only propose; factors are found by comparing bytes.  Rows with one id and text take part once, and the texts are
shuffled once, to buckets.  Hot blocks are aggregated before the shuffle; the joins read tables, so adaptive execution
can split a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import PLAIN_MASK, Words, grams, mix, pair, words_of

_LAST = (1 << 63) - 1
#: Words of a reference cell, the unit in which reference words are fetched.
CELL = 64
_SPANS = "array<struct<start:int,length:int,ref_id:long,ref_key:long,ref_start:int,reach:int>>"


def _blocks(w: Words, window: int, phrase: int) -> tuple[np.ndarray, ...]:
    """(document, start word, number of windows, anchor, block key) of each block, and all windows' hashes."""
    h = w.hash
    n, span = len(h), window - phrase + 1
    none = np.zeros(0, dtype=np.int64)
    if n < window:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64)
    phrases, windows = grams(h, phrase), grams(h, window)
    #: Order by the hash's upper bits, then by position: the leftmost smallest wins.
    key = (phrases & ~np.uint64(0xFFFFFFF)) | np.arange(len(phrases), dtype=np.uint64)
    low, width = key, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    anchor_at = (low & np.uint64(0xFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))[: n - window + 1]
    at = np.flatnonzero(np.arange(n - window + 1) + window <= w.first[doc + 1])
    a, d = anchor_at[at], doc[at]
    heads = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])]) if len(at) else none
    count = np.diff(np.r_[heads, len(at)])
    start, a = at[heads], a[heads]
    shape = (count.astype(np.uint64) << np.uint64(20)) + (a - start).astype(np.uint64)
    block = pair(pair(windows[start], windows[start + count - 1]), shape)  # its first and last window hold all its words
    return d[heads], start, count, phrases[a], block, windows


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _emit_blocks(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for w in words_of(batch.column(2), PLAIN_MASK, overlap=window - 1):
                d, start, count, anchor, block, _ = _blocks(w, window, phrase)
                if len(d):
                    columns = (ids[w.lo + d], keys[w.lo + d], (start - w.first[d] + w.base).astype(np.int32), count.astype(np.int32), _signed(anchor), _signed(block))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "text_key", "start", "windows", "anchor", "block"])

    return run


def _emit_windows(window: int, phrase: int):
    """Windows of those blocks of a document that are listed in its ``blocks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            wanted = batch.column(3)
            size_of = wanted.value_lengths().to_numpy(zero_copy_only=False)
            for w in words_of(batch.column(2), PLAIN_MASK, overlap=window - 1):
                d, start, count, anchor, block, windows = _blocks(w, window, phrase)
                if not len(d):
                    continue
                size = size_of[w.rows()]
                listed = wanted.slice(w.lo, len(size)).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(len(size)), size)
                #: A block is kept if its own document lists it.
                code = mix(block ^ mix(d.astype(np.uint64)))
                keep = np.isin(code, mix(listed.view(np.uint64) ^ mix(owner.astype(np.uint64))))
                d, start, count, anchor = d[keep], start[keep], count[keep], anchor[keep]
                if not len(d):
                    continue
                which = np.repeat(np.arange(len(d)), count)
                at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + start[which]
                owner = d[which]
                columns = (ids[w.lo + owner], keys[w.lo + owner], (at - w.first[owner] + w.base).astype(np.int32), _signed(anchor[which]), _signed(windows[at]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "text_key", "start", "anchor", "value"])

    return run


def _id(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST))


def matches(keyed: DataFrame, scratch: Scratch, window: int, phrase: int = 16) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Each block's and each window's reference, two tables (id, text_key, start, length, ref_id, ref_key, ref_start).

    They read the scratch tables that are returned with them.  ``keyed`` has id, text_key and text.  The words of a document's rows are exactly those of its windows that also
    start in a document with a smaller id, as far as hashes tell.
    """
    blocks = scratch.write(keyed.mapInArrow(_emit_blocks(window, phrase), "id long, text_key long, start int, windows int, anchor long, block long"), "blocks")
    index = blocks.groupBy("anchor", "block").agg(F.min(F.struct("id", "text_key", "start")).alias("ref"), F.max("id").alias("last"))
    index = scratch.write(index.select("anchor", "block", F.col("ref.id").alias("ref_id"), F.col("ref.text_key").alias("ref_key"), F.col("ref.start").alias("ref_start"), "last"), "index")

    repeated = index.where("last > ref_id").select("anchor", "block", "ref_id", "ref_key", "ref_start")
    whole = blocks.join(repeated, ["anchor", "block"]).where("id > ref_id").select("id", "text_key", "start", (F.col("windows") + window - 1).alias("length"), "ref_id", "ref_key", "ref_start")
    whole = scratch.write(whole, "whole")
    scratch.drop(blocks)

    differing = scratch.write(index.groupBy("anchor").agg(F.count("*").alias("n"), F.min("ref_id").alias("a"), F.max("last").alias("b")).where("n > 1 and a < b").select("anchor"), "anchors")
    listed = index.join(differing, "anchor").groupBy(F.col("ref_id").alias("id"), F.col("ref_key").alias("text_key")).agg(F.collect_set("block").alias("blocks"))
    listed = scratch.write(listed, "differing")
    scratch.drop(index)
    windows = scratch.write(keyed.join(listed, ["id", "text_key"]).select("id", "text_key", "text", "blocks").mapInArrow(_emit_windows(window, phrase), "id long, text_key long, start int, anchor long, value long"), "windows")
    first = windows.groupBy("anchor", "value").agg(F.min(F.struct("id", "text_key", "start")).alias("ref"), F.max("id").alias("last")).where("last > ref.id")
    first = scratch.write(first.select("anchor", "value", "ref"), "first")
    single = windows.join(first, ["anchor", "value"]).where("id > ref.id").select("id", "text_key", "start", F.lit(window).alias("length"), F.col("ref.id").alias("ref_id"), F.col("ref.text_key").alias("ref_key"), F.col("ref.start").alias("ref_start"))
    return whole, single, [whole, differing, listed, windows, first]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One document's matches: those that touch and have one pointer become one; ``reach`` tells how many words to fetch.

    A factor can't leave the run of words that matches cover; it is followed for up to four times its match's length.
    """
    for batch in batches:
        lists = batch.column(2)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in lists.flatten().flatten()]
        out, lengths, at = [], [], 0
        for size in sizes.tolist():
            start, length, ref_id, ref_key, ref_start = (c[at : at + size] for c in flat)
            at += size
            order = np.lexsort((start, ref_start - start, ref_key, ref_id))
            start, length, ref_id, ref_key, ref_start = (c[order] for c in (start, length, ref_id, ref_key, ref_start))
            line = np.cumsum(np.r_[True, (ref_id[1:] != ref_id[:-1]) | (ref_key[1:] != ref_key[:-1]) | ((ref_start - start)[1:] != (ref_start - start)[:-1])])
            end = np.maximum.accumulate(start + length + (line << 32)) - (line << 32)
            heads = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (start[1:] > end[:-1])])
            end = end[np.r_[heads[1:], size] - 1]
            start, ref_id, ref_key, ref_start = start[heads], ref_id[heads], ref_key[heads], ref_start[heads]
            order = np.argsort(start, kind="stable")
            start, end, ref_id, ref_key, ref_start = (c[order] for c in (start, end, ref_id, ref_key, ref_start))
            furthest = np.maximum.accumulate(end)
            run = np.cumsum(np.r_[False, start[1:] > furthest[:-1]])
            run_end = furthest[np.searchsorted(run, run, side="right") - 1]
            reach = np.minimum(run_end - start, 4 * (end - start) + CELL)
            out.append((start, end - start, ref_id, ref_key, ref_start, reach))
            lengths.append(len(start))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        names = ("start", "length", "ref_id", "ref_key", "ref_start", "reach")
        values = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), values)], names=["id", "text_key", "spans"])


def _spaced(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text's words with one space after each, and where each word begins (and the last ends)."""
    parts, sizes = [], []
    for w in words_of(text, PLAIN_MASK):
        size = w.end - w.start + 1
        ends = np.cumsum(size)
        out = np.full(int(ends[-1]) if len(ends) else 0, 32, dtype=np.uint8)
        place = np.ones(len(out), dtype=bool)
        place[ends - 1] = False
        out[place] = w.data[PLAIN_MASK[w.data]]
        parts.append(out)
        sizes.append(size)
    return np.concatenate([np.zeros(0, np.uint8), *parts]), np.r_[0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The listed cells of reference documents: rows (id, text_key, text, cells) to (ref_id, ref_key, cell, words)."""
    for batch in batches:
        wanted = batch.column(3)
        for row in range(batch.num_rows):
            spaced, begin = _spaced(batch.column(2).slice(row, 1))
            cells = np.sort(np.asarray(wanted[row].values)).tolist()
            last = len(begin) - 1
            blobs = [spaced[begin[min(c * CELL, last)] : begin[min((c + 1) * CELL, last)]].tobytes() for c in cells]
            ref = [batch.column(i).slice(row, 1).take(pa.array([0] * len(cells), pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ref, pa.array(cells, pa.int32()), pa.array(blobs, pa.binary())], names=["ref_id", "ref_key", "cell", "words"])


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """Words at the beginning of both that are the same bytes; every word ends with a space."""
    n = min(len(a), len(b))
    odd = np.flatnonzero(a[:n] != b[:n])
    return int(np.count_nonzero(a[: odd[0] if len(odd) else n] == 32))


def parse(spaced: np.ndarray, begin: np.ndarray, spans: list[dict], cells: dict[tuple[int, int, int], bytes], window: int) -> list[tuple[int, int, int, int]]:
    """Factors of one document, greedily from the left: (start, length, ref_id, ref_start) of ``window`` words or more.

    ``spans`` (by start) propose pointers, ``cells`` hold the reference words; only equal bytes make a factor.
    """
    factors: list[tuple[int, int, int, int]] = []

    def length_at(s: dict, at: int) -> int:
        """Words from ``at`` on that go on alike in the reference, as far as it was fetched."""
        cell, skip = divmod(s["ref_start"] + at - s["start"], CELL)
        place, total = int(begin[at]), 0
        while (blob := cells.get((s["ref_id"], s["ref_key"], cell))) is not None:
            words = np.frombuffer(blob, np.uint8)
            if skip:
                ends = np.flatnonzero(words == 32)
                words, skip = words[ends[skip - 1] + 1 if skip <= len(ends) else len(words) :], 0
            mine = spaced[place : place + len(words)]
            if len(mine) < len(words) or not np.array_equal(mine, words):
                return total + _same(mine, words)
            total += int(np.count_nonzero(words == 32))
            place, cell = place + len(words), cell + 1
        return total

    end = 0
    for k, span in enumerate(spans):
        stop = span["start"] + span["length"]
        at = max(span["start"], end - window + 1)
        while at + window <= stop:
            #: The longest of all references that the window has; a tie goes to the smallest document.
            options = [span]
            for other in spans[k + 1 :]:
                if other["start"] > at:
                    break
                if other["start"] + other["length"] >= at + window:
                    options.append(other)
            found = max(((length_at(s, at), -s["ref_id"], -(s["ref_start"] + at - s["start"])) for s in options), default=(0, 0, 0))
            if found[0] >= window:
                factors.append((at, found[0], -found[1], -found[2]))
                end = at + found[0]
                at = end - window + 1
            else:  # hashes agreed, bytes don't
                at += 1
    return factors


def _rewrite(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept, factors = [], [], [], []
            for row in range(batch.num_rows):
                spaced, begin = _spaced(batch.column(1).slice(row, 1))
                n = len(begin) - 1
                spans = batch.column(2)[row].as_py()
                found: list[tuple[int, int, int, int]] = []
                if spans:
                    cells = {(c["ref_id"], c["ref_key"], c["cell"]): c["words"] for c in batch.column(3)[row].as_py() or ()}
                    found = parse(spaced, begin, spans, cells, window)
                parts, at, gone = [], 0, 0
                for start, length, _, _ in found:
                    if start > at:
                        parts.append(spaced[begin[at] : begin[start]])
                    gone += start + length - max(at, start)
                    at = start + length
                parts.append(spaced[begin[at] :] if at < n else spaced[:0])
                total.append(n)
                removed.append(gone)
                kept.append(b"".join(p.tobytes() for p in parts)[:-1].decode())
                factors.append([dict(zip(("start", "length", "ref_id", "ref_start"), f, strict=True)) for f in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(4), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(factors, _FACTORS)],
                names=["doc_id", "copies", "n_words", "n_removed", "kept_text", "factors"],
            )

    return run


_FACTORS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_id", pa.int64()), ("ref_start", pa.int32())]))


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text, factors (the copied spans and where they point).

    Words are ``[^\\x20\\x09-\\x0D]+``; null and empty texts have none.  A word goes if a window of ``window``
    consecutive words that covers it also starts in a document with a smaller id; texts under ``window`` words stay
    whole.  A null id counts as the largest; rows with one id are one document that never matches itself.  Rows that
    repeat an id and text are parsed once and come out as often as they went in; other columns, whatever their names, are
    ignored.  Neighbouring factors overlap by less than a window where copies of different documents meet.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _id(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    #: The texts are shuffled once; everything that goes to a document afterwards joins its bucket.
    texts = rows.repartition(partitions, "id", "text_key").groupBy("id", "text_key", "doc_id", "text").agg(F.count("*").alias("copies"))
    texts = scratch.bucketed(texts, ["id", "text_key"], "texts")
    whole, single, tables = matches(texts.select("id", "text_key", "text"), scratch, window)
    lists = whole.unionByName(single).groupBy("id", "text_key").agg(F.collect_set(F.struct("start", "length", "ref_id", "ref_key", "ref_start")).alias("spans"))
    spans = scratch.write(lists.mapInArrow(_merge, f"id long, text_key long, spans {_SPANS}"), "spans")
    scratch.drop(*tables)
    wants = spans.select("id", "text_key", F.explode("spans").alias("s"))
    wants = wants.select("id", "text_key", "s.ref_id", "s.ref_key", F.explode(F.sequence(F.floor(F.col("s.ref_start") / CELL).cast("int"), F.floor((F.col("s.ref_start") + F.col("s.reach") - 1) / CELL).cast("int"))).alias("cell")).distinct()
    wants = scratch.write(wants, "wants")
    needed = scratch.write(wants.groupBy(F.col("ref_id").alias("id"), F.col("ref_key").alias("text_key")).agg(F.collect_set("cell").alias("cells")), "needed")
    cells = texts.join(needed, ["id", "text_key"]).select("id", "text_key", "text", "cells").mapInArrow(_cells, "ref_id long, ref_key long, cell int, words binary")
    cells = scratch.write(cells, "cells")
    fetched = wants.join(cells, ["ref_id", "ref_key", "cell"]).groupBy("id", "text_key").agg(F.collect_list(F.struct("ref_id", "ref_key", "cell", "words")).alias("cells"))
    facts = scratch.write(spans.join(fetched, ["id", "text_key"]), "facts")
    scratch.drop(spans, wants, needed, cells)
    joined = texts.join(facts, ["id", "text_key"], "left").select("doc_id", "text", "spans", "cells", "copies")
    found = joined.mapInArrow(_rewrite(window), "doc_id long, copies long, n_words long, n_removed long, kept_text string, factors array<struct<start:int,length:int,ref_id:long,ref_start:int>>")
    return found.select("doc_id", "n_words", "n_removed", "kept_text", "factors", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
