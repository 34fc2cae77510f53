"""From a table of sequences to a table of features: one logical plan, no action."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import RESIDUES
from ..functions.dialect import Dialect
from ..functions.vectors import stage, word_maps, word_rows
from ..operators import REGISTRY, Descriptor

SHARED = ("length", "valid_residue_count")


def clean(sequence: Column) -> Column:
    """Upper-cased, with the 20 residues only; null is empty."""
    return F.regexp_replace(F.upper(F.coalesce(sequence, F.lit(""))), f"[^{RESIDUES}]", "")


def prepared(df: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("string").alias("id"), clean(F.col(seq_col)).alias("seq"))
    return rows.withColumn("n", F.length("seq"))


def _features(d: Dialect, descriptors: Sequence[Descriptor], merged: bool) -> list[tuple[str, str]]:
    """(output column, expression).  Merged, the first descriptor's shared columns have no prefix, the others' go."""
    out = []
    for place, one in enumerate(descriptors):
        for name, sql in one.features(d):
            shared = name in SHARED
            if merged and shared and place:
                continue
            out.append((name if merged and shared else f"{one.name}_{name}", sql))
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def features_of(d: Dialect, descriptors: Descriptor | Iterable[Descriptor]) -> list[tuple[str, str]]:
    """(output column, expression) of one descriptor, or of several together."""
    one = isinstance(descriptors, Descriptor)
    return _features(d, [descriptors] if one else list(descriptors), merged=not one)


def _closure(d: Dialect, sqls: Iterable[str]) -> set[str]:
    """The intermediates and figures that the expressions need."""
    found: set[str] = set()
    left = set(sqls)
    while left:
        words = {w for sql in left for w in re.findall(r"[A-Za-z_]\w*", sql)} - found
        found |= words
        left = {d.lets[w] for w in words if w in d.lets}
    return found


def compute(df: DataFrame, descriptors: Descriptor | Iterable[Descriptor], id_col: str | None = "id", seq_col: str = "sequence", features: Iterable[str] | None = None) -> DataFrame:
    """``id`` (unless ``id_col`` is None) and the descriptors' features, all DOUBLE, one row per input row.

    A single descriptor's columns are all prefixed by its name; of several, the shared columns come once.  ``features``
    keeps the named output columns only: nothing else is computed.  A null or empty sequence has 0 counts and NaN
    otherwise.  Row-local throughout: no shuffle, and the same plan runs on a stream.
    """
    d = Dialect()
    wanted = None if features is None else set(features)
    listed = [(name, sql) for name, sql in features_of(d, descriptors) if wanted is None or name in wanted]
    if wanted and (missing := wanted - {name for name, _ in listed}):
        raise ValueError(f"no such features: {sorted(missing)[:5]}")
    rows = prepared(df.withColumn("__no_id", F.lit(None)) if id_col is None else df, id_col or "__no_id", seq_col)
    recipes = d.recipes.only(_closure(d, (sql for _, sql in listed)).__contains__)
    if recipes.figures:
        rows = rows.mapInArrow(stage(recipes), "id string, seq string, n int, " + ", ".join(f"`{k}` {recipes.kind(k)}" for k in recipes.figures))
    for step in d.stages():
        rows = rows.selectExpr("*", *(f"{sql} AS {name}" for name, sql in step))
    return rows.selectExpr(*([] if id_col is None else ["id"]), *(f"cast({sql} as double) AS {quoted(name)}" for name, sql in listed))


def long_kmers(df: DataFrame, k: int, id_col: str = "id", seq_col: str = "sequence") -> DataFrame:
    """id, kmer, n: the words of k residues that occur, as rows; for k where a column for each would be too many.

    Words are counted sequence by sequence.  The sequences meet by id once, in whole; only those that share an id have
    their words added up in another shuffle, which on a stream all have.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    rows = prepared(df, id_col, seq_col)
    words = lambda part: part.select("id", "seq", "n").mapInArrow(word_rows(k), "id string, kmer string, n double")
    added = lambda part: words(part).groupBy("id", "kmer").agg(F.sum("n").alias("n"))
    if rows.isStreaming:
        return added(rows)
    met = rows.withColumn("times", F.count("*").over(Window.partitionBy("id")))
    return words(met.where("times = 1")).unionByName(added(met.where("times > 1")))


def kmer_maps(df: DataFrame, k: int, id_col: str = "id", seq_col: str = "sequence") -> DataFrame:
    """id, total_kmers, unique_kmers, kmers: a map from the words of ``k`` residues that a sequence has to their counts.

    For k where a column for each word would be too many.  Row-local: a row for each input row, no shuffle; a sequence
    shorter than ``k``, or null, has an empty map.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    made = prepared(df, id_col, seq_col).mapInArrow(word_maps(k), "id string, total long, words map<string,double>")
    return made.select("id", F.col("total").cast("double").alias("total_kmers"), F.size("words").cast("double").alias("unique_kmers"), F.col("words").alias("kmers"))


def long_features(wide: DataFrame, id_col: str = "id") -> DataFrame:
    """id, feature, value: a row for each feature."""
    return wide.unpivot(id_col, [c for c in wide.columns if c != id_col], "feature", "value")


def make(names: Iterable[str], parameters: Mapping[str, Mapping[str, object]] | None = None) -> list[Descriptor]:
    """Descriptors by name, with parameters; unknown names raise KeyError."""
    return [REGISTRY[name](**dict((parameters or {}).get(name) or {})) for name in names]
