"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad.  A line's score is linear in its own features and in those of its two
neighbours; a transition matrix ties neighbouring labels.  Training takes each line of a labelled document as labelled
like the document, so it sees no change of label inside one: the matrix learns how strongly lines stick together, from
the pull of its own penalty against neighbours that always agree.  A document's quality is the mean of the lines' forward-backward marginals, weighted by line length,
then set against the labels by a logistic curve, so that 0.5 parts them.

Features are of the text alone: shares of kinds of characters, word shapes, lengths and repetition inside the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import PLAIN_MASK, Words, grams, mix, words_of

#: Labelled documents used for training, at most, the lines that one of them may have, and the lines of all.
TRAIN_DOCS, TRAIN_LINES, ALL_LINES = 3_000, 1_000, 200_000
SEED = 11


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for a, b in ranges:
        table[a:b] = True
    return table


_KINDS = {
    "upper": _bytes((65, 91)),
    "lower": _bytes((97, 123)),
    "beyond_ascii": _bytes((128, 256)),
    "digit": _bytes((48, 58)),
    "space": _bytes((9, 10), (11, 14), (32, 33)),
    "stop": _bytes((44, 45), (46, 47), (58, 60)),
    "mark": _bytes((33, 34), (63, 64)),
    "pipe": _bytes((124, 125), (92, 93), (47, 48)),
    "bracket": _bytes((40, 42), (60, 61), (62, 63), (91, 92), (93, 94), (123, 124), (125, 126)),
    "symbol": _bytes((35, 39), (42, 44), (61, 62), (64, 65), (94, 97), (126, 128)),
    "control": _bytes((0, 9), (14, 32)),
}
_ENDS_ODD = ~_bytes((48, 58), (65, 91), (97, 123), (128, 256), (44, 45), (46, 47), (33, 34), (63, 64), (58, 60), (34, 35), (39, 42))
_STOP_END = _bytes((33, 34), (46, 47), (63, 64))
N_FEATURES = len(_KINDS) + 10


@dataclass
class Lines:
    """Features of the lines of some documents: ``first[d] .. first[d + 1]`` are those of document ``d``."""

    lo: int
    first: np.ndarray
    weight: np.ndarray
    x: np.ndarray


def _sum(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many flags are set (or the sum of numbers) in each range."""
    total = np.zeros(len(flags) + 1, dtype=np.uint64 if flags.dtype == np.uint64 else np.int64)
    np.cumsum(flags, out=total[1:])
    return total[end] - total[start]


def _seen_before(keys: np.ndarray) -> np.ndarray:
    """Whether an equal key stands earlier in the array."""
    seen = np.ones(len(keys), dtype=bool)
    seen[np.unique(keys, return_index=True)[1]] = False
    return seen


class _Seen:
    """Keys of the pieces so far of one long text, in sorted runs of which each is at least twice the next."""

    def __init__(self) -> None:
        self.runs: list[np.ndarray] = []

    def before(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key stands earlier in this array or in one before; then takes them in."""
        seen = _seen_before(keys)
        for run in self.runs:
            if len(run):
                seen |= run[np.minimum(np.searchsorted(run, keys), len(run) - 1)] == keys
        self.runs.append(np.unique(keys))
        while len(self.runs) > 1 and len(self.runs[-2]) < 2 * len(self.runs[-1]):
            self.runs[-2:] = [np.union1d(*self.runs[-2:])]
        return seen


#: Words of a run that may repeat one before it in its text.
_RUN = 5


def _line_sums(w: Words, words_seen, runs_seen, into_line: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines of each document, a row of sums for each line, a key of each line's words) of a chunk or piece.

    Sums add up over the pieces of a line; ``into_line`` words of the first line are in pieces before this one.
    """
    skip = int(w.end[w.again - 1]) if w.again else 0
    offsets = w.offsets.copy()
    offsets[0] = skip
    breaks = np.flatnonzero(w.data == 10)
    breaks = breaks[breaks >= skip]
    start = np.sort(np.r_[offsets[:-1], breaks + 1], kind="stable")
    end = np.sort(np.r_[breaks, offsets[1:]], kind="stable")
    docs = len(offsets) - 1
    per_doc = np.bincount(np.searchsorted(offsets, breaks, side="right") - 1, minlength=docs) + 1
    sums = np.zeros((len(start), len(_KINDS) + 8), dtype=np.float64)
    for i, table in enumerate(_KINDS.values()):
        sums[:, i] = _sum(table[w.data], start, end)
    lo, hi = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    i = len(_KINDS)
    sums[:, i], sums[:, i + 1] = end - start, hi - lo
    keys = np.zeros(len(start), dtype=np.uint64)
    if len(w.start):
        h = w.hash
        last, head = w.data[w.end - 1], w.data[w.start]
        home = np.repeat(np.arange(docs), np.diff(w.first))
        owner = mix(home.astype(np.uint64) + np.uint64(1))
        again = np.zeros(len(h), dtype=bool)
        if len(h) >= _RUN:
            runs = grams(h, _RUN)
            whole = np.flatnonzero(np.arange(len(runs)) >= w.first[home[_RUN - 1 :]])  # none reaches back into another text
            again[whole + _RUN - 1] = runs_seen(runs[whole] ^ owner[whole])
        seen = np.zeros(len(h), dtype=bool)
        seen[w.again :] = words_seen((h ^ owner)[w.again :])
        for n, flags in enumerate((_ENDS_ODD[last], _STOP_END[last], (w.end - w.start) == 1, (head >= 65) & (head < 91), again, seen)):
            sums[:, i + 2 + n] = _sum(flags, lo, hi)
        place = np.arange(len(h)) - np.repeat(lo, np.diff(np.r_[lo, len(h)]))[: len(h)] if not w.again else np.arange(len(h)) - lo[np.maximum(np.searchsorted(lo, np.arange(len(h)), side="right") - 1, 0)]
        place[lo[0] : hi[0]] += into_line
        keys = _sum(mix(h + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), lo, hi)
    return per_doc, sums, keys


def _lines(lo: int, per_doc: np.ndarray, sums: np.ndarray, keys: np.ndarray) -> Lines:
    i = len(_KINDS)
    length, count = sums[:, i], sums[:, i + 1]
    size, words = np.maximum(length, 1), np.maximum(count, 1)
    x = np.zeros((len(sums), N_FEATURES), dtype=np.float32)
    x[:, :i] = sums[:, :i] / size[:, None]
    x[:, i] = np.log1p(length) / 5
    x[:, i + 1] = np.log1p(count) / 4
    x[:, i + 2] = np.minimum(length / words, 40) / 10
    x[:, i + 3 : i + 9] = sums[:, i + 2 :] / words[:, None]
    doc = np.repeat(np.arange(len(per_doc), dtype=np.uint64), per_doc)
    x[:, i + 9] = _seen_before(mix(keys) ^ mix(doc + np.uint64(1))) & (count > 0)
    return Lines(lo, np.r_[0, np.cumsum(per_doc)], np.maximum(length, 1).astype(np.float32), x)


def lines_of(column: pa.Array) -> Iterator[Lines]:
    """A text without a newline, even an empty or null one, is one line.

    A long text is read in pieces, of which only the lines' sums are held: about 200 bytes a line.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    words_seen, runs_seen = _Seen(), _Seen()
    for w in words_of(column, PLAIN_MASK, overlap=_RUN - 1):
        if not (w.more or w.base):
            yield _lines(w.lo, *_line_sums(w, _seen_before, _seen_before, 0))
            continue
        into = int(held[-1][0][-1, len(_KINDS) + 1]) if held else 0
        _, sums, keys = _line_sums(w, words_seen.before, runs_seen.before, into)
        if held:  # the line that the piece before has begun
            sums[0] += held[-1][0][-1]
            keys[:1] += held[-1][1][-1:]
            held[-1] = held[-1][0][:-1], held[-1][1][:-1]
        held.append((sums, keys))
        if not w.more:
            sums, keys = (np.concatenate(x) for x in zip(*held, strict=True))
            yield _lines(w.lo, np.array([len(sums)]), sums, keys)
            held, words_seen, runs_seen = [], _Seen(), _Seen()


def _with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (0 beyond the text), and a constant."""
    out = np.zeros((len(x), 3 * x.shape[1] + 1), dtype=np.float32)
    k = x.shape[1]
    out[:, :k] = x
    out[1:, k : 2 * k] = x[:-1]
    out[:-1, 2 * k : 3 * k] = x[1:]
    out[first[:-1], k : 2 * k] = 0
    out[first[1:] - 1, 2 * k : 3 * k] = 0
    out[:, -1] = 1
    return out


def _chain(score: np.ndarray, first: np.ndarray, move: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward-backward over all documents at once: P(good) of each line, and the sum of neighbouring pairs' marginals.

    Documents are taken by falling number of lines, so step t works on the first so many of them.
    """
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    begin, count = first[:-1][order], count[order]
    longest = int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(longest), side="left")
    emit = np.stack([np.ones(len(score)), np.exp(np.clip(score.astype(np.float64), -30, 30))], axis=1)
    forward, backward = np.empty_like(emit), np.empty_like(emit)
    now = None
    for t in range(longest):
        at = begin[: active[t]] + t
        now = emit[at] if t == 0 else (now[: active[t]] @ move) * emit[at]
        now /= now.sum(axis=1, keepdims=True)
        forward[at] = now
    for t in range(longest - 1, -1, -1):
        at = begin[: active[t]] + t
        now = np.ones((active[t], 2))
        more = active[t + 1] if t + 1 < longest else 0
        if more:
            after = at[:more] + 1
            part = (emit[after] * backward[after]) @ move.T
            now[:more] = part / part.sum(axis=1, keepdims=True)
        backward[at] = now
    both = forward * backward
    good = both[:, 1] / both.sum(axis=1)
    if not pairs:
        return good, None
    inner = np.ones(len(score), dtype=bool)
    inner[first[1:] - 1] = False
    at = np.flatnonzero(inner)
    joint = forward[at][:, :, None] * move[None] * (emit[at + 1] * backward[at + 1])[:, None, :]
    return good, (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    move: np.ndarray
    slope: float
    level: float

    def raw(self, lines: Lines) -> np.ndarray:
        """Log-odds of the length-weighted mean marginal of each document."""
        x = _with_neighbours((lines.x - self.mean) / self.scale, lines.first)
        good, _ = _chain(x @ self.weights.astype(np.float32), lines.first, self.move)
        q = np.add.reduceat(good * lines.weight, lines.first[:-1]) / np.add.reduceat(lines.weight, lines.first[:-1])
        return np.log(np.clip(q, 1e-6, 1)) - np.log(np.clip(1 - q, 1e-6, 1))

    def score(self, lines: Lines) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(lines) + self.level)))


def _adam(value: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    m = v = np.zeros_like(value)
    for t in range(1, steps + 1):
        g = gradient(value)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        value = value - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return value


def train(lines: Lines, labels: np.ndarray, steps: int = 100, penalty: float = 1e-3) -> Model:
    """Fits the field by gradient steps on the labelled lines' likelihood, then the logistic curve on the documents.

    Documents count alike, whatever their number of lines.  With one label only, every score is that label's share.
    """
    mean, scale = lines.x.mean(axis=0), lines.x.std(axis=0) + 1e-3
    count = np.diff(lines.first)
    x = _with_neighbours((lines.x - mean) / scale, lines.first)
    y = np.repeat(labels, count).astype(np.float64)
    inner = np.repeat(1.0 / count / len(labels), count)
    k = x.shape[1]
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (count[labels == label] - 1).sum()
    total_pairs = max(1.0, seen.sum())

    def gradient(p: np.ndarray) -> np.ndarray:
        move = np.exp(p[k:].reshape(2, 2))
        good, joint = _chain(x @ p[:k].astype(np.float32), lines.first, move, pairs=True)
        g = ((good - y) * inner).astype(np.float32) @ x
        return np.r_[g + penalty * p[:k], ((joint - seen) / total_pairs).ravel() + 0.05 * p[k:]]

    p = _adam(np.zeros(k + 4), gradient, steps, 0.05)
    model = Model(mean, scale, p[:k], np.exp(p[k:].reshape(2, 2)), 1.0, 0.0)
    raw, y = model.raw(lines), labels.astype(np.float64)

    def curve(c: np.ndarray) -> np.ndarray:
        off = 1 / (1 + np.exp(-(c[0] * raw + c[1]))) - y
        return np.array([(off * raw).mean() + 1e-3 * (c[0] - 1), off.mean()])

    model.slope, model.level = _adam(np.array([1.0, 0.0]), curve, 400, 0.02).tolist()
    return model


def held_out(doc_id):
    """The fold that no label is learnt from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lines in lines_of(batch.column(1)):
            blobs = [lines.x[a:b].tobytes() for a, b in zip(lines.first[:-1], lines.first[1:], strict=True)]
            weights = [lines.weight[a:b].tobytes() for a, b in zip(lines.first[:-1], lines.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lines.lo, len(blobs)), pa.array(blobs, pa.binary()), pa.array(weights, pa.binary())], names=["label", "x", "weight"])


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES, all_lines: int = ALL_LINES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """A model from at most ``train_docs`` labelled documents outside the held-out fold, chosen by a hash of their id.

    Null labels, labelled ids that no document has and documents of more than ``train_lines`` lines are left out of
    training (not of scoring); so are those at which the lines taken so far, in that order, exceed ``all_lines``.  What
    reaches the driver is bounded by that number, 84 bytes a line.  Of several labels of one id the largest counts,
    of several texts the smallest.  None if there is nothing to learn from.
    """
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    usable = usable.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64(F.lit(SEED), F.col("__id")), "__id").limit(train_docs)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "__id")
    #: Lines are counted after the grouping, so only in texts that have a label.
    texts = texts.groupBy("__id", "label").agg(F.min("text").alias("text"))
    n_lines = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    texts = texts.withColumn("n_lines", n_lines).where(F.col("n_lines") <= train_lines)
    #: One task, over at most train_docs rows.
    texts = texts.withColumn("so_far", F.sum("n_lines").over(Window.orderBy(F.xxhash64(F.lit(SEED), F.col("__id")), "__id"))).where(F.col("so_far") <= all_lines)
    found = texts.select("label", "text").mapInArrow(_features, "label int, x binary, weight binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r.label, bytes(r.x)))
    x = [np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in found]
    first = np.r_[0, np.cumsum([len(a) for a in x])]
    return train(Lines(0, first, np.concatenate([np.frombuffer(r.weight, np.float32) for r in found]), np.concatenate(x)), np.array([r.label for r in found]))


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lines in lines_of(batch.column(1)):
                n = len(lines.first) - 1
                score = model.score(lines) if model else np.full(n, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lines.lo, n), pa.array(score.astype(np.float64))], names=["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1, higher is better), predicted (1 from 0.5 on).

    Null counts as the empty text: one empty line.  Without a model every score is 0.5.  Scores depend on the text only.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows whose text the model predicts good, columns unchanged."""
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for lines in lines_of(batch.column(column)):
                n = len(lines.first) - 1
                keep[lines.lo : lines.lo + n] = model.score(lines) >= 0.5 if model else True
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_scores(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
