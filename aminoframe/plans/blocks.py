"""Features of sequences of any length: the sequences in blocks, the blocks' states merged.

The plan of ``engine`` has a row for each sequence, so one sequence is one task's work.  Here a sequence's blocks are
spread over the tasks, and the same declared features are evaluated over the merged states in place of the sequence.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InputError
from ..functions.alphabet import RESIDUES
from ..functions.dialect import Dialect
from ..functions.states import RUNS, WORD, Plan, merges
from ..operators import Descriptor
from ..sources.tables import require_ids
from .engine import features_of, prepared, quoted

#: Residues of a block, and what a window or an end may take at most of the next one.
BLOCK, REACH = 1 << 18, 1 << 10
#: Blocks that begin in a span of so many residues are one task's, so that their states are merged before a shuffle.
SPAN = 1 << 18
_OTHER = re.compile(f"[^{RESIDUES}]")
_END = re.compile(r"\b(?:left|right)\(seq, (\d+)\)")
_WORD = re.compile(r"[A-Za-z_]\w*")
_LITERAL = re.compile(r"'(?:[^'\\]|\\.)*'")


def cut(df: DataFrame, id_col: str = "id", seq_col: str = "sequence", block: int = BLOCK, halo: int = REACH) -> DataFrame:
    """(id, at, own, halo): a row for each ``block`` residues of a sequence, the last one shorter; one row for an empty one.

    ``at`` counts the residues before; ``halo`` has the first ones of the next block.
    """
    rows = prepared(df, id_col, seq_col)
    if halo > block:
        raise ValueError("a block must be at least as long as its halo")
    pieces = rows.select("id", F.when(F.col("n") <= block, F.array("seq")).otherwise(F.expr(f"regexp_extract_all(seq, '.{{1,{block}}}', 0)")).alias("pieces"))
    each = F.transform("pieces", lambda own, i: F.struct((i.cast("long") * block).alias("at"), own.alias("own"), F.left(F.coalesce(F.get("pieces", i + 1), F.lit("")), F.lit(halo)).alias("halo")))
    return pieces.select("id", F.explode(each).alias("b")).select("id", "b.at", "b.own", "b.halo")


def _fragments(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Residues of up to about ``block`` a row, from lines in the order of their files.

    (file, begin of the split, number in the split, id or null before the split's first header, residues of the record
    before in this split, residues).  A header makes a row, with or without residues behind it.
    """
    schema = pa.schema([("file", pa.string()), ("begin", pa.int64()), ("k", pa.int64()), ("id", pa.string()), ("at", pa.int64()), ("seq", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, name, k, at, held, size, rows = None, None, 0, 0, [], 0, []

        def flush() -> None:
            nonlocal k, at, held, size
            if held:
                rows.append((*split, k, name, at, "".join(held)))
                k, at, held, size = k + 1, at + size, [], 0

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({f.name: [r[i] for r in rows] for i, f in enumerate(schema)}, schema=schema)
            rows.clear()
            return made

        for batch in batches:
            for raw, *place in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if split != tuple(place):
                    if split:
                        flush()
                    split, name, k, at = tuple(place), None, 0, 0
                line = raw.decode("utf-8").strip()
                if line.startswith(">"):
                    flush()
                    name, at = (line[1:].split() or [""])[0], 0
                    rows.append((*split, k, name, 0, ""))
                    k += 1
                elif kept := _OTHER.sub("", line.upper()):
                    held.append(kept)
                    size += len(kept)
                    if size >= block:
                        flush()
            if sum(len(r[5]) for r in rows) > 1 << 24 or len(rows) > 10_000:
                yield out()
        if split:
            flush()
        yield out()

    return run


def read_fasta_blocks(spark: SparkSession, path: str, block: int = BLOCK, halo: int = REACH, check_ids: bool = True) -> DataFrame:
    """(id, at, own, halo) of FASTA files, as ``cut`` makes them: no task holds more of a sequence than some blocks.

    Files are split over tasks by lines.  What a split has before its first header continues the record of the splits
    before it, which a table with a row for each split tells.  Ids must be there and differ (``check_ids``).
    """
    try:
        lines = spark.read.text(path).select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"))
    except PySparkException as e:
        raise InputError(f"{path}: {e.getCondition() or e}") from e
    found = lines.mapInArrow(_fragments(block), "file string, begin long, k long, id string, at long, seq string")
    splits = found.groupBy("file", "begin").agg(F.expr("max_by(id, k)").alias("last"), F.expr("max_by(at + length(seq), k)").alias("behind"))
    #: Splits belong together from one with a header to the next: all of their residues are the same record's.
    order = Window.partitionBy("file").orderBy("begin")
    known = splits.select("*", F.count("last").over(order).alias("since"), F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("open"))
    sums = known.groupBy("file", F.col("since").alias("before")).agg(F.sum("behind").alias("all"))
    upto = F.sum("behind").over(Window.partitionBy("file", "since").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    inside = known.select("file", "begin", "open", F.when(F.col("last").isNull(), upto).alias("upto"), F.when(F.col("last").isNotNull(), F.col("since") - 1).alias("before"))
    carry = inside.join(sums, ["file", "before"], "left").select("file", "begin", "open", F.coalesce("upto", "all", F.lit(0)).alias("carried"))
    placed = found.join(carry, ["file", "begin"]).select(F.coalesce("id", "open").alias("id"), (F.col("at") + F.when(F.col("id").isNull(), F.col("carried")).otherwise(0)).alias("at"), "seq").where("id is not null")
    if check_ids:
        require_ids(found.where("id is not null and at = 0 and seq = ''").select("id"))
    #: Pieces of the grid; the first of a block are the halo of the one before as well.
    to = F.floor((F.col("at") + F.greatest(F.length("seq"), F.lit(1)) - 1) / block)
    grid = placed.select("id", "at", "seq", F.explode(F.sequence(F.floor(F.col("at") / block), to)).alias("b"))
    here = F.greatest(F.col("b") * block - F.col("at"), F.lit(0))
    piece = grid.select("id", "b", (F.col("at") + here).alias("at"), F.substring("seq", (here + 1).cast("int"), ((F.col("b") + 1) * block - F.col("at") - here).cast("int")).alias("seq"))
    ahead = piece.where(F.col("b") > 0).select("id", (F.col("b") - 1).alias("b"), "at", F.left("seq", F.greatest(F.lit(0), halo - (F.col("at") - F.col("b") * block)).cast("int")).alias("seq"))
    whole = piece.unionByName(ahead.where("seq <> ''")).groupBy("id", "b").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    return whole.select("id", (F.col("b") * block).alias("at"), F.left("seq", F.lit(block)).alias("own"), F.substring("seq", block + 1, halo).alias("halo"))


class _Needs:
    """What some features need of a sequence: figures, runs, residues at the ends, or all of it."""

    def __init__(self, d: Dialect) -> None:
        self.d = d

    def of(self, sql: str) -> tuple[set[str], set[str], int, bool]:
        """(figures, intermediates, residues at an end, whether the whole sequence is needed)."""
        names: set[str] = set()
        reach, whole, left = 0, False, [sql]
        while left:
            text = left.pop()
            reach = max([reach, *(int(w) for w in _END.findall(text))])
            words = set(_WORD.findall(_LITERAL.sub("''", _END.sub("''", text)))) - names
            whole |= "seq" in words
            names |= words
            left += [self.d.lets[w] for w in words if w in self.d.lets and not self.given(w)]
        figures = {w for w in names if w in self.d.recipes.figures}
        reach = max([reach, *(f[2][1] for w in figures if (f := self.d.recipes.figures[w])[0] == "scaled" and f[2])])
        whole |= any(not merges(self.d.recipes, w) for w in figures)
        return figures, {w for w in names if w in self.d.lets}, reach, whole

    @staticmethod
    def given(name: str) -> bool:
        """Whether merged states have an intermediate."""
        return name.startswith("count_seq_") or bool(RUNS.fullmatch(name))


def mergeable(descriptors: Descriptor | Iterable[Descriptor]) -> dict[str, bool]:
    """Output columns of ``compute_long``, and whether states of blocks give them."""
    d = Dialect()
    listed = features_of(d, descriptors)
    needs = _Needs(d)
    return {name: not needs.of(sql)[3] for name, sql in listed}


def compute_blocks(blocks: DataFrame, descriptors: Descriptor | Iterable[Descriptor], features: Iterable[str] | None = None, halo: int = REACH) -> DataFrame:
    """As ``engine.compute``, from (id, at, own, halo) as ``cut`` makes them.

    The blocks are dealt to the tasks by spans, their states meet once by id, with sums made before the shuffle.  A descriptor's
    features that need a whole sequence at once (patterns, medians of places, quantiles) raise unless ``features`` leaves
    them out; ``mergeable`` tells which do.
    """
    d = Dialect()
    wanted = None if features is None else set(features)
    listed = [(name, sql) for name, sql in features_of(d, descriptors) if wanted is None or name in wanted]
    if wanted and (missing := wanted - {name for name, _ in listed}):
        raise ValueError(f"no such features: {sorted(missing)[:5]}")
    needs = _Needs(d)
    found = {name: needs.of(sql) for name, sql in listed}
    if apart := [name for name, need in found.items() if need[3]]:
        raise ValueError(f"features of whole sequences, {len(apart)} in all: {apart[:5]}")
    figures = set().union(*(need[0] for need in found.values()))
    lets = set().union(*(need[1] for need in found.values()))
    runs = {m[1] for name in lets if (m := RUNS.fullmatch(name))}
    plan = Plan(d.recipes.only(figures.__contains__), runs, max([0, *(need[2] for need in found.values())]))
    if max(plan.halo(), plan.reach) > halo:
        raise ValueError(f"windows of {plan.halo() + 1} and ends of {plan.reach} residues need a longer halo")
    dealt = blocks.select("id", "at", "own", "halo").repartition("id", F.floor(F.col("at") / SPAN)).sortWithinPartitions("id", "at")
    states = dealt.mapInArrow(plan.stage(), ", ".join(f"`{name}` {kind}" for name, kind in plan.columns()))
    merged = states.groupBy("id").agg(*map(F.expr, plan.fold()))
    if plan.runs:
        merged = merged.selectExpr("*", *(f"{sql} AS {name}" for name, sql in plan.joined_runs()))
    if plan.words:
        words = dealt.mapInArrow(plan.word_stage(), WORD).groupBy("id", "k", "word").agg(F.sum("c").alias("c"), F.min("first").alias("first"), F.max("last").alias("last"))
        merged = merged.join(words.groupBy("id").agg(*map(F.expr, plan.word_figures())), "id", "left")
    rows = merged.selectExpr("id", "seq", "n", *(c for c in merged.columns if c.startswith("count_seq_")), *(f"{sql} AS {name}" for name, sql in plan.figures()))
    for step in d.stages():
        rows = rows.selectExpr("*", *(f"{sql} AS {name}" for name, sql in step if name in lets and not needs.given(name)))
    return rows.selectExpr("id", *(f"cast({sql} as double) AS {quoted(name)}" for name, sql in listed))


def compute_long(df: DataFrame, descriptors: Descriptor | Iterable[Descriptor], id_col: str = "id", seq_col: str = "sequence", features: Iterable[str] | None = None, block: int = BLOCK) -> DataFrame:
    """``compute_blocks`` of a table of whole sequences.  Ids must differ: rows of one id count as one sequence."""
    halo = min(block, REACH)
    return compute_blocks(cut(df, id_col, seq_col, block, halo), descriptors, features, halo)
