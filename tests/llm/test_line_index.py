"""The line index between sessions, and updates that must fail."""

from __future__ import annotations

import pytest
from brute import lines, texts
from pyspark.sql import functions as F

from aminoframe.llm import line_dedup
from aminoframe.llm.scratch import shared_dir


def table(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")


def result(index, docs):
    return sorted(map(tuple, index.apply(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()), key=repr)


def test_an_index_can_be_opened_again(spark):
    folder = shared_dir(spark, "lines")
    first, second = table(spark, "a\nb", "a\nc"), table(spark, "a\nd", "b")
    line_dedup.LineDedupIndex(spark, folder, threshold=3).insert(first)
    again = line_dedup.LineDedupIndex(spark, folder)
    assert (again.version, again.threshold) == (1, 3)
    again.insert(second)
    third = line_dedup.LineDedupIndex(spark, folder)
    assert [r[2] for r in result(third, first)] == [1, 1]
    third.delete(second)
    third = line_dedup.LineDedupIndex(spark, folder)
    assert third.version == 3 and [r[2] for r in result(third, first)] == [0, 0]


def test_unknown_documents_cannot_be_deleted(spark):
    index = line_dedup.LineDedupIndex(spark, threshold=2)
    index.insert(table(spark, "a\nb", "a\nb", "a", None))
    before = sorted(map(tuple, index.counts().collect()))
    for wrong in (table(spark, "b"), table(spark, "a\nb", "a\nb", "a\nb"), table(spark, "a", "a")):
        with pytest.raises(ValueError, match="never inserted"):
            index.delete(wrong)
        assert index.version == 1 and sorted(map(tuple, index.counts().collect())) == before
    index.delete(table(spark, "a\nb", None))
    assert sorted(r.n_docs for r in index.counts().collect()) == [1, 2]


def test_overfull_filters_grow(spark, monkeypatch):
    """Filters that are much too small for their keys are built anew with more shards."""
    rows = texts(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    monkeypatch.setattr(line_dedup.CuckooFilter, "KICKS", 0)
    index = line_dedup.LineDedupIndex(spark, threshold=1)
    index.insert(docs)
    assert result(index, docs) == sorted(lines(rows, 1), key=repr)
