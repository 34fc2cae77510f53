"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes.  Two fingerprints within two bits differ in at most two bytes, so they share at
least six.  Posting lists of single bytes would hold 1/256 of all fingerprints each, so the index posts every four
positions with their bytes (70 lists a fingerprint, 2**32 values each): a pair that shares six bytes meets in C(6, 4) = 15
lists at least, one that shares five in 5.  The lists a pair shares are tallied, pairs that reach 15 are retained, and
those are verified by their differing bits.

A list of more than ``LONG_LIST`` members emits no pairs.  All its members are indexed once more by six positions: a pair
within two bits that met in a long list meets there, in a list whose members differ in two bytes only.  Such a list
yields links that span its groups instead of all its pairs, so nothing is lost and nothing grows with its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, join_counted, written
from .words import LOWER

POSITIONS, SHARED = 8, 6
#: Positions that a list is keyed by.  Fewer make longer lists, more make the tally a mere join; 2**32 keys keep lists of
#: unrelated fingerprints to one or two members up to ten billion of them.
POSTED = 4
#: Members of a list that is paired in full; 16 are 120 pairs.
LONG_LIST = 16
_NONE = -(1 << 63)  # as the second of a pair it is the smaller one, which it never is
_SPACE = bytes([9, 10, 11, 12, 13, 32])
_TABLE = bytes(32 if b in _SPACE else int(LOWER[b]) for b in range(256))


def fingerprint(text: bytes, words: int = 3) -> int:
    """Of the space-joined ``words``-word shingles, repeats included; fewer words: the whole sequence; none: 0."""
    tokens = text.translate(_TABLE).split(b" ")
    if b"" in tokens:
        tokens = [t for t in tokens if t]
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[s:e], 42) for s, e in zip(starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(tokens) - k + 1)
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint as a signed long."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _posting_keys(fp, size: int) -> list:
    """One key for every ``size`` positions: which they are, and a hash of their bytes (the bytes, for up to six)."""
    keys = []
    for number, chosen in enumerate(combinations(range(POSITIONS), size)):
        mask = sum(255 << (8 * p) for p in chosen)
        keys.append(F.struct(F.lit(number).cast("byte").alias("at"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")).alias("bytes")))
    return keys


def _list_links(fps: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Links within ``k`` bits that connect whatever the members of one posting list connect: fewer than members."""
    n = len(fps)
    label, links = np.arange(n), []
    value = fps.view(np.uint64)
    step = max(1, (1 << 22) // n)
    for lo in range(0, n, step):
        near = np.bitwise_count(value[lo : lo + step, None] ^ value[None, :]) <= k
        rows, columns = np.nonzero(near)
        rows += lo
        for i, j in zip(rows[rows < columns].tolist(), columns[rows < columns].tolist(), strict=True):
            a, b = i, j
            while label[a] != a:
                label[a] = label[label[a]]
                a = label[a]
            while label[b] != b:
                label[b] = label[label[b]]
                b = label[b]
            if a != b:
                label[max(a, b)] = min(a, b)
                links.append((int(fps[i]), int(fps[j])))
    return links


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Members of each posting list from batches (at, bytes, fp) in order of the first two; lists of one are left out."""
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        held = [np.concatenate([h, batch.column(i).to_numpy().astype(np.int64)]) for i, h in enumerate(held)]
        at, key, fp = held
        if not len(at):
            continue
        heads = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (key[1:] != key[:-1])])
        for lo, hi in zip(heads[:-1], heads[1:], strict=True):  # the last list may go on in the next batch
            if hi - lo > 1:
                yield fp[lo:hi]
        held = [h[heads[-1] :] for h in held]
    if len(held[0]) > 1:
        yield held[2]


def _link(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members in _lists(batches):
            out = _list_links(members, k)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs (a, b) of short lists; a row (a, null) for each member of a long one."""
    a, b, held = [], [], 0

    def out() -> pa.RecordBatch:
        first, second = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(first), pa.array(second, mask=second == _NONE)], names=["a", "b"])

    for members in _lists(batches):
        if len(members) > LONG_LIST:
            a.append(members)
            b.append(np.full(len(members), _NONE))
        else:
            i, j = np.triu_indices(len(members), 1)
            a.append(np.minimum(members[i], members[j]))
            b.append(np.maximum(members[i], members[j]))
        held += len(a[-1])
        if held > 1 << 16:
            yield out()
            a, b, held = [], [], 0
    yield out()


def near_links(distinct: DataFrame, k: int = 2) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints (column fp), at most ``k`` differing bits each.

    Every pair within ``k`` bits is connected by a path of these links.
    """
    if not 0 <= k <= POSITIONS - SHARED:
        raise ValueError("the posting lists guarantee six shared bytes for at most two differing bits")
    scratch = Scratch(distinct.sparkSession, "postings")

    def posted(fps: DataFrame, size: int) -> DataFrame:
        posts = fps.select(F.explode(F.array(*_posting_keys(F.col("fp"), size))).alias("key"), "fp").select("key.at", "key.bytes", "fp")
        return posts.repartition("at", "bytes").sortWithinPartitions("at", "bytes", "fp")

    met = scratch.write(posted(distinct.select("fp"), POSTED).mapInArrow(_pairs, "a long, b long"), "met")
    tally = met.where("b is not null").groupBy("a", "b").agg(F.count("*").alias("lists")).where(F.col("lists") >= math.comb(SHARED, POSTED))
    links = tally.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= k).select("a", "b")
    crowded = scratch.write(met.where("b is null").select(F.col("a").alias("fp")).distinct(), "crowded")
    return links.unionAll(posted(crowded, SHARED).mapInArrow(_link(k), "a long, b long"))


def simhash_components(docs: DataFrame, k: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp, component_id (smallest doc_id that a path of links reaches).

    Null, empty and blank texts have fingerprint 0 and are linked like any other; texts under three words are one
    shingle.  Rows with one id are nodes of their own; null ids never become a component's id unless all are null.
    """
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    roots = components(near_links(distinct.select("fp"), k))
    joined = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    joined = written(joined, "roots")
    smallest = written(joined.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members")), "smallest")
    classes = written(join_counted(joined, smallest, "root", "members").select("fp", "component_id", "n"), "classes")
    return join_counted(prints, classes, "fp", "n").select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, k: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest, columns unchanged.

    Rows that repeat an id are one document: they stay if one of them is its component's smallest.
    """
    smallest = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = simhash_components(docs, k, id_col, text_col).groupBy(F.col("doc_id").alias("__gone")).agg(F.max(smallest).alias("__stays")).where("not __stays").select("__gone")
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__gone"]), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = simhash_components(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
