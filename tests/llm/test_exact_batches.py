"""Exact deduplication over several calls on one folder."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from aminoframe.llm import exact_dedup
from aminoframe.llm.scratch import HOT_ROWS, join_counted, remove, shared_dir, written


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, text string")


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=repr)


def test_a_reused_folder_answers_for_all_rows(spark):
    folder = shared_dir(spark, "reuse")
    exact_dedup.exact_dedup(table(spark, (1, "a"), (2, "b")), folder=folder)
    found = exact_dedup.exact_dedup(table(spark, (3, "a"), (4, "c")), folder=folder)
    assert result(found) == [(1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False), (4, 4, 1, True)]
    found = exact_dedup.exact_dedup(table(spark, (0, "a")), folder=folder)
    assert result(found) == [(0, 0, 3, True), (1, 0, 3, False), (2, 2, 1, True), (3, 0, 3, False), (4, 4, 1, True)]


def test_a_retried_batch_counts_once(spark):
    folder = shared_dir(spark, "retry")
    for _ in range(2):
        found = exact_dedup.exact_dedup(table(spark, (1, "a"), (2, "a")), folder=folder)
        assert result(found) == [(1, 1, 2, True), (2, 1, 2, False)]
    for _ in range(2):
        found = exact_dedup.exact_dedup(table(spark, (1, "a"), (2, "a")), folder=folder, batch="monday")
    assert [r[2] for r in result(found)] == [4, 4, 4, 4]


def test_an_interrupted_call_leaves_nothing_behind(spark):
    folder = shared_dir(spark, "broken")
    exact_dedup.exact_dedup(table(spark, (1, "a")), folder=folder)
    lost = table(spark, (7, "a")).select("doc_id", exact_dedup.sha256(F.col("text")).alias("digest"), "text")
    lost.write.parquet(f"{folder}/inbox/load=lost")
    assert result(exact_dedup.exact_dedup(table(spark, (2, "b")), folder=folder)) == [(1, 1, 1, True), (2, 2, 1, True)]


def test_bytes_are_checked_against_earlier_batches(spark):
    def forged(text):
        return F.unhex(F.sha2(F.substring(text, 1, 1), 256))

    dedup = exact_dedup.ExactDedup(spark, digest=forged)
    dedup.add(table(spark, (5, "ab"), (6, "c")))
    dedup.add(table(spark, (7, "ab"), (8, "d")))
    with pytest.raises(ValueError, match="share the digest"):
        dedup.add(table(spark, (4, "ax")))
    dedup = exact_dedup.ExactDedup(spark, digest=forged)
    with pytest.raises(ValueError, match="share the digest"):
        dedup.add(table(spark, (5, "ab"), (6, "ac")))


def test_the_locator_finds_the_kept_text(spark):
    dedup = exact_dedup.ExactDedup(spark)
    dedup.add(table(spark, (5, "a  b"), (6, "c")))
    dedup.add(table(spark, (2, "a\nb")))
    row = dedup.groups().where("keep_id = 2").first()
    assert [(r.doc_id, r.text) for r in spark.read.parquet(f"{dedup.folder}/inbox/{row.file}").where("doc_id = 2").collect()] == [(2, "a b")]


def test_hot_keys_join_like_others(spark):
    rows = written(spark.range(3 * HOT_ROWS).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), "id"), "rows")
    facts = written(rows.groupBy("k").agg(F.count("*").alias("n")), "facts")
    joined = join_counted(rows, facts, "k", "n")
    assert joined.count() == 3 * HOT_ROWS
    assert joined.where("n <> case when k = 0 then 20001 else 1 end").count() == 0
    remove(facts._scratch_path)


def test_the_bitmap_of_hits_loses_none(spark):
    rows = spark.range(20_000).select(exact_dedup.sha256(F.col("id").cast("string")).alias("digest"), "id")
    hits = rows.where("id % 100 = 7").select("digest")
    found = {r.id for r in exact_dedup._marked_by(hits, rows).collect()}
    assert {i for i in range(7, 20_000, 100)} <= found and len(found) < 260
