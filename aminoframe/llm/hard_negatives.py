"""Hard negatives: for each anchor and each of its positives, the best rows of other labels that score nearly as high.

Every row is in a product quantisation index: for each part of the vector the nearest of 256 centroids, and how far the row
lies from it.  For an anchor, a table of its scores with the centroids gives a row's score up to the sum, over the parts,
of residual norm times the anchor's norm.  Only rows whose bounds leave them a place are scored exactly, in integers.

Anchors meet rows in blocks: both are dealt into groups of bounded size, and a task takes a block of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Parts of a vector, and centroids of each.
PARTS, CENTROIDS = 8, 256
#: Integers up to this are exact as doubles.
_EXACT = 2**53


@dataclass
class Codebook:
    """``bounds``: where the parts of a vector begin and end; ``centroids[m]``: those of part m."""

    bounds: np.ndarray
    centroids: list[np.ndarray]

    @property
    def wide(self) -> int:
        return int(self.bounds[-1])

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, a:b] for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, residual norm) for each row and part."""
        codes = np.stack([_nearest(part, c) for part, c in zip(self.split(x), self.centroids, strict=True)], axis=1)
        rest = np.stack([np.linalg.norm(part - c[codes[:, m]], axis=1) for m, (part, c) in enumerate(zip(self.split(x), self.centroids, strict=True))], axis=1)
        return codes.astype(np.uint8), rest


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    half = (centroids**2).sum(axis=1) / 2
    for lo in range(0, len(x), 8192):
        out[lo : lo + 8192] = (half - x[lo : lo + 8192] @ centroids.T).argmin(axis=1)
    return out


def fit_codebook(sample: np.ndarray, parts: int = PARTS, centroids: int = CENTROIDS, rounds: int = 8) -> Codebook:
    """k-means in each part of the vectors; starts from the sample's first distinct rows."""
    wide = sample.shape[1]
    book = Codebook(np.linspace(0, wide, min(parts, wide) + 1).astype(int), [])
    for x in book.split(sample):
        _, first = np.unique(x, axis=0, return_index=True)
        c = x[np.sort(first)[:centroids]].copy()
        for _ in range(rounds):
            of = _nearest(x, c)
            n = np.bincount(of, minlength=len(c))
            for j in range(x.shape[1]):
                c[:, j] = np.where(n > 0, np.bincount(of, weights=x[:, j], minlength=len(c)) / np.maximum(n, 1), c[:, j])
        book.centroids.append(c)
    return book


def _matrix(column: pa.Array | pa.ChunkedArray, wide: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), wide))
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(column)), sizes), place] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _indexed(book: Codebook, groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(vec_id, label, v) with codes, residual norms and the group, by a row's place in the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        for batch in batches:
            codes, rest = book.encode(_matrix(batch.column(2), book.wide))
            group = (at + np.arange(batch.num_rows)) % groups
            at += batch.num_rows
            m = codes.shape[1]
            codes = pa.array([bytes(c) for c in codes], pa.binary())
            rest = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * m), pa.array(rest.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, codes, rest, pa.array(group.astype(np.int32))], names=["vec_id", "label", "v", "codes", "rest", "g"])

    return run


class _Block:
    """Indexed rows of a group, and their scores with an anchor: bounds of all, exact ones of some."""

    def __init__(self, book: Codebook, rows: pa.Table) -> None:
        self.book = book
        self.ids = rows.column("vec_id").to_numpy()
        self.labels = rows.column("label").to_numpy()
        self.x = _matrix(rows.column("v"), book.wide)
        self.rest = _matrix(rows.column("rest"), len(book.centroids))
        codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), dtype=np.uint8).reshape(len(self.ids), len(book.centroids))
        self.codes = codes.T.astype(np.int64)
        self.high = float(np.abs(self.x).max(initial=0))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Below and above every row's score, with room for the rounding of doubles."""
        about, off = np.zeros(len(self.ids)), np.full(len(self.ids), 1e-3)
        for m, part in enumerate(self.book.split(q[None])):
            norm = float(np.linalg.norm(part))
            table = self.book.centroids[m] @ part[0]
            about += table[self.codes[m]]
            off += self.rest[:, m] * norm + 1e-9 * np.abs(table).max(initial=0)
        off *= 1 + 1e-9
        return about - off, about + off

    def exact(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Integer inner products; Python's integers where doubles could round."""
        if self.high * float(np.abs(q).max(initial=0)) * len(q) < _EXACT:
            return (self.x[at] @ q).astype(np.int64)
        whole = [int(v) for v in q]
        return np.array([sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in self.x[at]] + [None], dtype=object)[:-1]

    def best(self, q: np.ndarray, able: np.ndarray, k: int, low: int | None = None, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of the first ``k`` of the ``able`` rows with scores from ``low`` to ``high``."""
        under, over = self._bounds
        if low is not None:
            able = able & (over >= low) & (under <= high)
            sure = under[able & (under >= low) & (over <= high)]
        else:
            sure = under[able]
        if len(sure) > k:
            able = able & (over >= np.partition(sure, len(sure) - k)[len(sure) - k])
        at = np.flatnonzero(able)
        at = at[np.argsort(self.ids[at], kind="stable")]
        score = self.exact(q, at)
        if low is not None:
            inside = np.array((score >= low) & (score <= high), dtype=bool)
            at, score = at[inside], score[inside]
        first = np.argsort(-score, kind="stable")[:k]
        return at[first], score[first]

    def meet(self, q: np.ndarray) -> None:
        self._bounds = self.bounds(q)


def _whole(values: list[int]) -> pa.Array:
    if any(not -(2**63) <= v < 2**63 for v in values):
        raise OverflowError("a score doesn't fit in 64 bits; scale the vectors down")
    return pa.array(values, pa.int64())


def _positives(book: Codebook, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        block, out = _Block(book, rows), []
        vectors = _matrix(anchors.column("v"), book.wide)
        for q, anchor, vec_id, label in zip(vectors, *(anchors.column(c).to_pylist() for c in ("anchor", "anchor_id", "label")), strict=True):
            able = (block.labels == label) & (block.ids != vec_id)
            if able.any():
                block.meet(q)
                out += [(anchor, int(block.ids[at]), int(score)) for at, score in zip(*block.best(q, able, k), strict=True)]
        return pa.table({"anchor": pa.array([r[0] for r in out], pa.int64()), "positive_id": pa.array([r[1] for r in out], pa.int64()), "positive_score": _whole([r[2] for r in out])})

    return run


def _negatives(book: Codebook, k: int, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``low`` and ``high``: bounds of a negative's score in per cent of the positive's."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        block, out = _Block(book, rows), []
        vectors = _matrix(anchors.column("v"), book.wide)
        for q, anchor, vec_id, label, positives in zip(vectors, *(anchors.column(c).to_pylist() for c in ("anchor", "anchor_id", "label", "positives")), strict=True):
            able = (block.labels != label) & (block.ids != vec_id)
            if not able.any():
                continue
            block.meet(q)
            for p in positives:
                least, most = -((-low * p["positive_score"]) // 100), high * p["positive_score"] // 100
                if least <= most:
                    out += [(anchor, p["place"], int(block.ids[at]), int(score)) for at, score in zip(*block.best(q, able, k, least, most), strict=True)]
        return pa.table({"anchor": pa.array([r[0] for r in out], pa.int64()), "place": pa.array([r[1] for r in out], pa.int32()), "negative_id": pa.array([r[2] for r in out], pa.int64()), "negative_score": _whole([r[3] for r in out])})

    return run


def _first(rows: DataFrame, keys: list[str], score: str, name: str, k: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), name)
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, sample_rows: int = 8192, group_rows: int = 4096, anchor_rows: int = 4096, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchors`` holds for.

    Components count as floor(scale x).  An anchor's positives are the first ``positives`` rows of its label; for each,
    the first ``negatives`` rows of other labels whose score is ``low`` to ``high`` per cent of the positive's are
    returned.  Higher scores come first, of equal ones the smaller id.  The result is exact: bounds only spare work.

    Rows with a null id, label or vector, or a null or non-finite component, take no part.  Shorter vectors count as
    ending in zeros; empty ones score 0.  Rows of the anchor's own id are neither positives nor negatives; otherwise
    rows that repeat count each.  Anchors equal in id, label and vector are one.  Scores beyond 64 bits raise.  An empty
    table, or one without anchors, gives no rows; other columns are ignored.

    Codebooks are fitted on at most ``sample_rows`` rows, those with the smallest hashes; every row is indexed.  A task
    takes about ``group_rows`` rows and ``anchor_rows`` anchors at a time.
    """
    spark = rows.sparkSession
    v = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    able = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(finite, F.lit(False))
    table = rows.where(able).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), v.alias("v"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    scratch = Scratch(spark, "negatives")
    n, wide = table.agg(F.count("*"), F.max(F.size("v"))).first()
    chosen = table.select("v").orderBy(F.xxhash64("vec_id", "v"), "v").limit(sample_rows).toArrow()
    book = fit_codebook(_matrix(chosen.column("v"), max(1, wide or 0))) if n else Codebook(np.array([0, 1]), [np.zeros((1, 1))])
    groups = max(64, -(-n // group_rows))
    index = scratch.write(table.select("vec_id", "label", "v").mapInArrow(_indexed(book, groups), "vec_id long, label int, v array<double>, codes binary, rest array<double>, g int"), "index")
    named = table.where("is_anchor").select("vec_id", "label", "v").dropDuplicates().select(F.monotonically_increasing_id().alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "v")
    asked = scratch.write(named, "anchors")
    blocks = max(1, -(-asked.count() // anchor_rows))
    block = F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int").alias("block")

    def met(asking: DataFrame, find: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        here = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("g", "block")
        there = asking.select("*", block).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).groupBy("g", "block")
        return here.cogroup(there).applyInArrow(find, schema)

    found = met(asked, _positives(book, positives), "anchor long, positive_id long, positive_score long")
    best = scratch.write(_first(found, ["anchor"], "positive_score", "positive_id", positives, "place"), "positives")
    of = best.groupBy("anchor").agg(F.collect_list(F.struct("place", "positive_score")).alias("positives"))
    near = met(asked.join(of, "anchor"), _negatives(book, negatives, low, high), "anchor long, place int, negative_id long, negative_score long")
    ranked = _first(near, ["anchor", "place"], "negative_score", "negative_id", negatives, "rank")
    out = ranked.join(best, ["anchor", "place"]).join(asked.select("anchor", "anchor_id"), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


#: The same in DuckDB, from all pairs of anchors and rows.
SQL = """
    WITH e AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS place FROM s WHERE same) WHERE place <= 5)
    SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score
    FROM (
        SELECT p.a AS anchor_id, p.b AS positive_id, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
        FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
    ) WHERE rank <= 5"""
