"""Near copies by the similarity of their word shingles: every pair of a Jaccard similarity of 0.8 or more, none missed.

A document is the set of its shingles' 64-bit hashes.  In any fixed order of the shingles two sets of that similarity
share SHARED of them among the first fifth and SHARED more of each (prefix filter; sets of fewer shingles share what
they can), so only those are posted.  The order puts shingles that a sample finds in many documents last, which keeps
posting lists short; the sample never changes the result.  Pairs that pass the filters by size and position are counted
over all lists, and those that reach the guaranteed count are verified on their texts.

Only lists of up to LONG members give pairs at once.  A member with few postings in long lists (less than half of the
guaranteed count) meets all that are similar to it in short lists too, so those pairs need no more.  The others are
compared with one hub each: of all members of its long lists the one that stands in most long lists, which lists of one
group have in common.  That decides the link with the hub.  Two members share no more than the smaller of their overlaps
with the hub (taken in parts), and what they share beyond it; so those that the links leave apart are paired through lists
of what they have beyond the hub, by a prefix filter again.  What a hub happens to lack of its group's common text would
make such lists as long as the group: shingles that a part of the members finds often beyond the hub are counted with the
hub's own for these bounds, which hold for any set; which ones never changes the result.  Only pairs that the hub alone
leaves possible, or without a common hub, are paired from the long lists themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import join_counted, written
from .simhash_dedup import fingerprint, near_links
from .words import PLAIN_MASK, grams, pair, words_of

#: Similarity as a fraction; shingles of one document in SAMPLE are counted, those of COMMON of them or more come last.
SIMILARITY, SAMPLE, COMMON, MOST_COMMON = (4, 5), 64, 4, 1 << 18
#: The guaranteed count of shared postings.
SHARED = 16
#: Lists of more members are not paired before each of these has been compared with its hub.
LONG, SALTS = 32, 16
#: The guaranteed count of shared postings beyond a hub.
BEYOND = 8
#: Parts of a hub's shingles; how many of each two members have bounds what they share within the hub.
PARTS = 64
_NO_PARTS = bytes(4 * PARTS)
#: One member of a hub in GAUGED tells what is common beyond it: shingles of OFTEN of these or more, and of one in RARE.
GAUGED, OFTEN, RARE = 16, 2, 1024
_POST = "key long, node long, n int, at int"


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, node, sorted distinct shingle hashes) of each text; equal word sequences (A-Z folded) have equal nodes.

    Texts of fewer words are one shingle; texts without words have none.  A long text is read in pieces.
    """
    digest, sets = hashlib.blake2b(digest_size=8), []
    for w in words_of(column, PLAIN_MASK, fold=True, overlap=words - 1):
        h = w.hash
        for d in range(len(w.first) - 1):
            lo, hi = int(w.first[d]), int(w.first[d + 1])
            old = lo + w.again
            if old < hi:
                line = w.data[w.start[old] : w.end[hi - 1]]
                line = line[PLAIN_MASK[line]].tobytes()  # the words, then where they end
                digest.update(line + (w.end[old:hi] - w.start[old:hi]).astype("<i8").tobytes())
            k = min(words, hi - lo)
            sets.append(np.unique(pair(grams(h[lo:hi], k), np.uint64(k))) if k and (k == words or not (w.base or w.more)) else np.zeros(0, np.uint64))
            if not w.more:
                yield w.lo + d, int.from_bytes(digest.digest(), "little", signed=True), sets[0] if len(sets) == 1 else np.unique(np.concatenate(sets))
                digest, sets = hashlib.blake2b(digest_size=8), []


def _prints(words: int):
    """(doc_id, node, mark, fp): with the text's SimHash, which texts of one node have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = pa.array([node for _, node, _ in shingle_sets(batch.column(1), words)], pa.int64())
            found = {node: text for node, text in zip(nodes.to_pylist(), batch.column(1), strict=True)}
            found = {node: fingerprint(text.as_buffer().to_pybytes() if text.is_valid else b"") for node, text in found.items()}
            prints = np.fromiter((found[node] for node in nodes.to_pylist()), np.uint64, len(nodes))
            yield pa.RecordBatch.from_arrays([batch.column(0), nodes, batch.column(2), pa.array(prints.view(np.int64))], names=["doc_id", "node", "mark", "fp"])

    return run


def _nodes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [node for _, node, _ in shingle_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), batch.column(2)], names=["doc_id", "node", "mark"])

    return run


def _sampled(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, np.ndarray] = {node: s for _, node, s in shingle_sets(batch.column(0), words)}
            for s in seen.values():
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["key"])

    return run


def _postings(words: int, last: np.ndarray, similarity: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        num, den = similarity
        for batch in batches:
            sets = {node: s for _, node, s in shingle_sets(batch.column(0), words) if len(s)}
            keys, ns = [], []
            for s in sets.values():
                n = len(s)
                s = _rare_first(s, last)
                least = -(num * n // -den)  # ceil(num / den * n)
                keys.append(s[: n - least + min(SHARED, least)])
                ns.append(n)
            lengths = np.fromiter(map(len, keys), np.int64, len(keys))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            nodes = np.repeat(np.fromiter(sets, np.int64, len(sets)), lengths)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            columns = [flat.view(np.int64), nodes, np.repeat(np.array(ns, np.int32), lengths), at.astype(np.int32)]
            for lo in range(0, len(flat), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 16)]) for c in columns], names=["key", "node", "n", "at"])

    return run


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole runs of equal first column, several runs at once."""
    held: list[np.ndarray] = []
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
        if len(held[0]):
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                yield [c[:cut] for c in held]
                held = [c[cut:] for c in held]
    if held and len(held[0]):
        yield held


def _near_sizes(n: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Whether members i and j of a list can be so similar, given where the list's shingle stands in either."""
    num, den = similarity
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    shared = np.minimum(at[i], at[j]) + np.minimum(n[i] - at[i], n[j] - at[j])
    return (den * small >= num * large) & ((num + den) * shared >= num * (n[i] + n[j]))


def _lacking(n: np.ndarray, overlap: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """How many shingles members i and j must share beyond their common hub to be so similar; 0 or less if none."""
    return _needed(n, i, j, similarity) - np.minimum(overlap[i], overlap[j])


def _within(parts: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """At most so many of their common hub's shingles are in both members i and j."""
    each = np.frombuffer(b"".join(parts[np.r_[i, j]]), np.int32).reshape(2, len(i), PARTS)
    return np.minimum(each[0], each[1]).sum(axis=1, dtype=np.int64)


def _needed(n: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """How many shingles members i and j must share to be so similar."""
    num, den = similarity
    return -(-num * (n[i] + n[j]) // (num + den))


def _beyond(similarity: tuple[int, int]) -> Callable:
    """(a, b, least) for each list of a shingle beyond a hub, from (key, node, n, root, hub, overlap, tail, at, parts).

    Of what two members must share beyond the hub, the longer one of their tails can hide no more than its length: what
    either tail hides of the shared shingles stands behind all that is shared before it.  Where the list's shingle stands
    beyond the hub bounds what they share there.  Members whose overlaps alone would do have no tails, so those that the
    parts tell to need something beyond the hub share it in a list here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        num, den = similarity
        pairs: list[tuple[np.ndarray, ...]] = []
        held = 0

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*pairs, strict=True)], names=["a", "b", "least"])
            pairs.clear()
            return made

        for key, node, n, root, hub, overlap, tail, at, parts in _by_group(batches):
            n, overlap, at = n.astype(np.int64), overlap.astype(np.int64), at.astype(np.int64)
            behind = n - overlap - at
            bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            for lo, hi in zip(*(x[np.diff(bounds) > 1] for x in (bounds[:-1], bounds[1:])), strict=True):
                for x in range(lo, hi - 1):
                    i, j = np.full(hi - 1 - x, x), np.arange(x + 1, hi)
                    lack = _lacking(n, overlap, i, j, similarity)
                    ok = (hub[i] == hub[j]) & (root[i] != root[j]) & (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j]))
                    room = np.minimum(at[i], at[j]) + np.minimum(behind[i], behind[j])
                    ok &= room >= lack
                    if ok.any():
                        i, j, room = i[ok], j[ok], room[ok]
                        lack = _needed(n, i, j, similarity) - _within(parts, i, j)
                        ok = (lack > 0) & (room >= lack)
                        i, j, lack = i[ok], j[ok], lack[ok]
                        pairs.append((np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), lack - np.maximum(tail[i], tail[j])))
                        held += len(i)
                        if held > 1 << 16:
                            yield out()
                            held = 0
        if pairs:
            yield out()

    return run


def _pairs(similarity: tuple[int, int], rooted: bool) -> Callable:
    """(a, b) of each list with the smaller set's size in n.

    Of a long list only the members come (key not null), unless they have their roots and hubs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a=(), b=(), n=(), key=(), node=(), at=()) -> pa.RecordBatch:
            rows = len(a) + len(key)
            pad = lambda x, kind: pa.array(x if len(x) else [None] * rows, kind)
            return pa.RecordBatch.from_arrays([pad(a, pa.int64()), pad(b, pa.int64()), pad(key, pa.int64()), pad(node, pa.int64()), pad(n, pa.int32()), pad(at, pa.int32())], names=["a", "b", "key", "node", "n", "at"])

        num, den = similarity
        pairs, held = [], 0
        for columns in _by_group(batches):
            key, node, n, at = columns[:4]
            n, at = n.astype(np.int64), at.astype(np.int64)
            if rooted:
                root, hub, overlap, parts = columns[4:8]
            bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            for lo, hi in zip(*(x[np.diff(bounds) > 1] for x in (bounds[:-1], bounds[1:])), strict=True):
                _, first = np.unique(node[lo:hi], return_index=True)  # copies post the same
                members = first + lo
                if not rooted and len(members) > LONG:
                    yield out(key=key[members], node=node[members], n=n[members], at=at[members])
                    continue
                if rooted and (hub[members] == hub[members[0]]).all():  # the others lack something with any other
                    members = members[den * overlap[members] >= num * n[members]]
                    if (root[members] == root[members[:1]]).all():
                        continue
                for x in range(len(members) - 1):
                    i, j = np.full(len(members) - 1 - x, members[x]), members[x + 1 :]
                    ok = _near_sizes(n, at, i, j, similarity)
                    if rooted:
                        ok &= (root[i] != root[j]) & ((hub[i] != hub[j]) | (_lacking(n, overlap, i, j, similarity) <= 0))
                    if rooted and ok.any():  # a hub itself has been compared with its members, and has no parts
                        i, j = i[ok], j[ok]
                        ok = (hub[i] != hub[j]) | (_within(parts, i, j) >= _needed(n, i, j, similarity))
                    if ok.any():
                        i, j = i[ok], j[ok]
                        pairs.append((np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), np.minimum(n[i], n[j])))
                        held += len(i)
                    if held > 1 << 16:
                        yield out(*map(np.concatenate, zip(*pairs, strict=True)))
                        pairs, held = [], 0
        if held:
            yield out(*map(np.concatenate, zip(*pairs, strict=True)))

    return run


def _met(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, np.ndarray]]:
    """(hub, its shingles, common ones, other, its shingles) from rows (hub, salt, other, text, common) sorted by the first three.

    A hub's own text has no other and comes first.
    """
    hub, own, common, done = None, np.zeros(0, np.uint64), np.zeros(0, np.uint64), None
    for batch in batches:
        hubs, _, others = (batch.column(i).to_pylist() for i in range(3))
        for row, _, s in shingle_sets(batch.column(3), words):
            if others[row] is None:
                hub, own, common = hubs[row], s, np.array(batch.column(4)[row].as_py() or [], np.int64).view(np.uint64)
            elif hub == hubs[row] and done != (hub, others[row]):
                done = hub, others[row]
                yield hub, own, common, others[row], s


def _verify(words: int, similarity: tuple[int, int]):
    """The pairs that are so similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        num, den = similarity
        found = [(hub, other) for hub, own, _, other, s in _met(batches, words) if (num + den) * len(np.intersect1d(own, s, assume_unique=True)) >= num * (len(own) + len(s))]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _rare_first(s: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Shingles in order, those of ``last`` behind all others."""
    if not len(last):
        return s
    common = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
    return np.r_[s[~common], s[common]]


def _lacked(words: int):
    """(hub, key) for each shingle that a member has beyond its hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hub, own, _, _, s in _met(batches, words):
            rest = np.setdiff1d(s, own, assume_unique=True)
            for lo in range(0, len(rest), 1 << 16):
                part = pa.array(rest[lo : lo + (1 << 16)].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([hub], pa.int64()).take(pa.array(np.zeros(len(part), np.int64))), part], names=["hub", "key"])

    return run


def _compare(words: int, last: np.ndarray, similarity: tuple[int, int]):
    """(node, hub, overlap, similar, rest, tail, parts): how many shingles a text shares with its hub and those common beyond it, and the first of the others.

    Of its n shingles any similar text shares at least num / den n, so as many less the overlap beyond these.  All but
    BEYOND of as many are left out of the rest: its ``tail``.  Whether it is similar is told by the hub's own shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        num, den = similarity
        made: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.int32(), pa.binary()))]
            made.clear()
            return pa.RecordBatch.from_arrays(columns, names=["node", "hub", "overlap", "similar", "rest", "tail", "parts"])

        for hub, own, common, other, s in _met(batches, words):
            both = np.isin(s, own, assume_unique=True)
            similar = (num + den) * int(both.sum()) >= num * (len(own) + len(s))
            both |= np.isin(s, common, assume_unique=True)
            parts = np.bincount((s[both] >> np.uint64(58)).astype(np.int64), minlength=PARTS).astype(np.int32)
            rest = _rare_first(s[~both], last)
            overlap = len(s) - len(rest)
            lack = max(1, -(-num * len(s) // den) - overlap)
            tail = max(0, lack - BEYOND)
            made.append((other, hub, overlap, similar, rest[: max(0, len(rest) - tail)].view(np.int64), tail, parts.tobytes()))
            if len(made) >= 512:
                yield out()
        yield out()

    return run


def _meet(pairs: DataFrame, rows: DataFrame, distinct: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """(hub, salt, other, text, common) of pairs (a: the hub, b) for ``_met``; a hub of very many pairs is salted.

    A node's text is that of its first row, found by its id and the text's hash.
    """
    many = pairs.groupBy("a").count().select(F.col("a").alias("of"), F.when(F.col("count") > 100 * SALTS, SALTS).otherwise(1).alias("salts"))
    salted = pairs.join(many, pairs.a == many.of).select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    none = F.lit(None).cast("array<long>").alias("common")
    hubs = salted.select(F.col("a").alias("hub"), "salt").distinct()
    hubs = hubs.join(common, "hub", "left") if common is not None else hubs.select("hub", "salt", none)
    wanted = hubs.select("hub", "salt", F.lit(None).cast("long").alias("other"), F.col("hub").alias("node"), "common")
    wanted = wanted.unionAll(salted.select(F.col("a").alias("hub"), "salt", F.col("b").alias("other"), F.col("b").alias("node"), none))
    wanted = wanted.join(distinct.select("node", "first", "mark"), "node").select("first", "mark", "hub", "salt", "other", "common")
    found = rows.join(wanted, rows.doc_id.eqNullSafe(F.col("first")) & (F.xxhash64(rows.text) == F.col("mark"))).select("hub", "salt", "other", "text", "common")
    return found.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("other").asc_nulls_first())


def _common_beyond(asked: DataFrame, rows: DataFrame, distinct: DataFrame, words: int) -> DataFrame:
    """(hub, common): the shingles that many members of a hub have beyond it, by the members that gauge it; at most RARE texts' worth of them."""
    gauged = written(asked.where(F.pmod(F.xxhash64("b", "a"), F.lit(GAUGED)) == 0), "gauged")
    sizes = gauged.groupBy("a").count().where(F.col("count") >= OFTEN).select(F.col("a").alias("of"), F.greatest(F.lit(OFTEN), F.floor(F.col("count") / RARE)).alias("least"))
    gauged = gauged.join(sizes, gauged.a == sizes.of).select("a", "b")
    counts = _meet(gauged, rows, distinct).mapInArrow(_lacked(words), "hub long, key long").groupBy("hub", "key").count().where(F.col("count") >= OFTEN)
    often = counts.join(sizes, counts.hub == sizes.of).where(F.col("count") >= F.col("least"))
    return written(often.groupBy("hub").agg(F.collect_list("key").alias("common")), "common")


def _links(pairs: DataFrame, rows: DataFrame, distinct: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that are so similar."""
    return _meet(pairs, rows, distinct).mapInArrow(_verify(words, similarity), "a long, b long")


def _alike(distinct: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) from each node to the smallest node of its SimHash class: op2's links, at most ``bits`` differing bits."""
    prints = distinct.select("fp").distinct()
    roots = components(near_links(prints, bits)).withColumnRenamed("node", "of")
    classed = written(distinct.join(roots, distinct.fp == roots.of, "left").select("node", F.coalesce("root", "fp").alias("class")), "classed")
    least = written(classed.groupBy("class").agg(F.min("node").alias("a"), F.count("*").alias("members")).where("members > 1"), "least")
    return written(join_counted(classed, least, "class", "members").where("node <> a").select("a", F.col("node").alias("b")), "alike")


def shingle_components(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """One row per input row: doc_id, node, component_id (smallest doc_id that a path of similar pairs reaches).

    With ``bits``, texts whose SimHash differs in so many bits or fewer are linked first, by SimHash's own index and tally;
    what that joins is not verified again.
    Null, empty and blank texts are copies of each other; null ids never become a component's id unless all are null.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = rows.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    of_first = [F.min("doc_id").alias("first"), F.coalesce(F.min_by("mark", "doc_id"), F.first("mark")).alias("mark"), F.count("*").alias("copies")]
    if bits is None:
        nodes = written(marked.mapInArrow(_nodes(words), "doc_id long, node long, mark long"), "nodes")
        distinct = written(nodes.groupBy("node").agg(*of_first), "distinct")
    else:
        nodes = written(marked.mapInArrow(_prints(words), "doc_id long, node long, mark long, fp long"), "nodes")
        distinct = written(nodes.groupBy("node").agg(*of_first, F.first("fp").alias("fp")), "distinct")
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(_sampled(words), "key long")
    common = sample.groupBy("key").count().where(F.col("count") >= COMMON).orderBy(F.desc("count")).limit(MOST_COMMON).select("key").toArrow()
    last = np.sort(common.column(0).to_numpy().astype(np.int64).view(np.uint64))
    posts = rows.select("text").mapInArrow(_postings(words, last, similarity), _POST)
    found = "a long, b long, " + _POST
    first = written(posts.repartition("key").sortWithinPartitions("key").mapInArrow(_pairs(similarity, False), found), "pairs")
    num, den = similarity
    least = lambda n: F.least(F.lit(SHARED), F.ceil(n * num / den))
    short = written(first.where("a is not null").groupBy("a", "b").agg(F.min("n").alias("n"), F.count("*").alias("short")), "tallied")
    long = first.where("key is not null").select("key", "node", "n", "at")
    alike = _alike(distinct, bits) if bits is not None else distinct.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    if long.isEmpty():
        links = written(_links(short.where(F.col("short") >= least(F.col("n"))).select("a", "b"), rows, distinct, words, similarity), "links")
    else:
        few = F.least(F.lit(SHARED), F.ceil(F.col("n") * num * num / (den * den)))
        crowded = written(long.groupBy("node").agg(F.first("n").alias("n"), F.count("*").alias("in_long")).withColumn("deep", 2 * F.col("in_long") >= few), "crowded")
        of = lambda x: crowded.select(F.col("node").alias(x), F.col("in_long").alias(f"in_long_{x}"), F.col("deep").alias(f"deep_{x}"))
        met = short.join(of("a"), "a", "left").join(of("b"), "b", "left")
        met = met.withColumn("upto", F.col("short") + F.when(F.col("in_long_a").isNull() | F.col("in_long_b").isNull(), 0).otherwise(F.least("in_long_a", "in_long_b")))
        met = written(met.where(F.col("upto") >= least(F.col("n"))).select("a", "b", "n", "short", (F.coalesce("deep_a", F.lit(False)) & F.coalesce("deep_b", F.lit(False))).alias("deep")), "met")
        links = written(_links(met.where("not deep").select("a", "b"), rows, distinct, words, similarity), "links")
        members = crowded.where("deep").select("node", "n", "in_long")
        long = written(long.join(members.select("node", "in_long"), "node").select("key", "node", "n", "at", "in_long"), "long")
        best = long.groupBy("key").agg(F.max(F.struct("in_long", "node")).alias("best"))
        hubs = written(long.select("key", "node", "n").join(best, "key").groupBy("node", "n").agg(F.max("best").alias("best")).select("node", "n", F.col("best.node").alias("hub")), "hubs")
        asked = hubs.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
        usual = _common_beyond(asked, rows, distinct, words)
        compared = written(_meet(asked, rows, distinct, usual).mapInArrow(_compare(words, last, similarity), "node long, hub long, overlap int, similar boolean, rest array<long>, tail int, parts binary"), "compared")
        links = links.unionAll(compared.where("similar").select(F.col("hub").alias("a"), F.col("node").alias("b")))
        roots = written(components(links.unionAll(alike)), "roots").withColumnRenamed("node", "of")
        judged = hubs.join(roots, hubs.node == roots.of, "left").select("node", "n", "hub", F.coalesce("root", "node").alias("root"))
        judged = written(judged.join(compared.select("node", "overlap", "rest", "tail", "parts"), "node", "left").select("node", "n", "root", "hub", F.coalesce("overlap", "n").alias("overlap"), "rest", "tail", F.coalesce("parts", F.lit(_NO_PARTS)).alias("parts")), "judged")
        rooted = long.join(judged.select("node", "root", "hub", "overlap", "parts"), "node").select("key", "node", "n", "at", "root", "hub", "overlap", "parts")
        more = rooted.repartition("key").sortWithinPartitions("key").mapInArrow(_pairs(similarity, True), found)
        both = more.select("a", "b", "n", F.lit(1).cast("long").alias("short")).unionAll(met.where("deep").select("a", "b", "n", "short"))
        both = both.groupBy("a", "b").agg(F.min("n").alias("n"), F.sum("short").alias("short")).where(F.col("short") >= least(F.col("n"))).select("a", "b")
        rest = judged.select(F.posexplode("rest").alias("at", "shingle"), "node", "n", "root", "hub", "overlap", "tail", "parts").select(F.xxhash64("hub", "shingle").alias("key"), "node", "n", "root", "hub", "overlap", "tail", "at", "parts")
        beyond = rest.repartition("key").sortWithinPartitions("key").mapInArrow(_beyond(similarity), "a long, b long, least long")
        beyond = beyond.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("least").alias("least")).where("shared >= least").select("a", "b")
        root = lambda x: judged.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
        apart = both.union(beyond).distinct().join(root("a"), "a").join(root("b"), "b").where("root_a <> root_b").select("a", "b")
        links = links.unionAll(written(_links(written(apart, "apart"), rows, distinct, words, similarity), "links"))
    roots = components(links.unionAll(alike)).withColumnRenamed("node", "of")
    joined = written(distinct.join(roots, distinct.node == roots.of, "left").select("node", "first", "copies", F.coalesce("root", "node").alias("root")), "roots")
    smallest = written(joined.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members")), "smallest")
    classes = written(join_counted(joined, smallest, "root", "members").select("node", "component_id", "copies"), "classes")
    return join_counted(nodes, classes, "node", "copies").select("doc_id", "node", "component_id")


def shingle_dedup(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest, columns unchanged.

    Rows that repeat an id are one document: they stay if one of them is its component's smallest.
    """
    smallest = F.col("doc_id").eqNullSafe(F.col("component_id"))
    found = shingle_components(docs, words, similarity, id_col, text_col, bits)
    gone = found.groupBy(F.col("doc_id").alias("__gone")).agg(F.max(smallest).alias("__stays")).where("not __stays").select("__gone")
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__gone"]), "left_anti")
