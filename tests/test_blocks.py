"""Sequences in blocks: the same figures as from whole rows."""

from __future__ import annotations

import math
import random

import pytest

from aminoframe.errors import IdError
from aminoframe.operators import REGISTRY
from aminoframe.plans.blocks import compute_blocks, compute_long, cut, mergeable, read_fasta_blocks
from aminoframe.plans.engine import compute, make
from aminoframe.sources.tables import read_sequences

R = random.Random(8)
ALL = "ACDEFGHIKLMNPQRSTVWY"
SEQS = ["", None, "A", "AC", "K" * 100, "A" * 57 + "K" * 63, "BJOUXZ", *("".join(R.choices(R.choice([ALL, "AK", "GGGPF"]), k=n)) for n in (19, 20, 21, 39, 40, 41, 60, 100, 2000))]
WHOLE = {name for name in REGISTRY if all(mergeable(make([name])[0]).values())}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(str(i), s, 1, "x") for i, s in enumerate(SEQS)], "id string, sequence string, at int, halo string").repartition(3).cache()


def same(a, b):
    return b is not None and (math.isnan(a) and math.isnan(b) or abs(a - b) <= 1e-9 * max(1, abs(a)))


def test_most_descriptors_merge():
    assert WHOLE == set(REGISTRY) - {"ctd_classic", "distribution", "local_repetition", "normalized", "pattern", "spacing", "user_regex"}
    assert sum(v for k, v in mergeable(make(["local_repetition"])[0]).items()) == 33


@pytest.mark.parametrize("names", [["sliding_window", "hydrophobicity"], ["run_blockiness", "order_disorder", "entropy_complexity"], ["autocorrelation", "pseaac", "sequence_order", "family_summary"], ["charge", "aaindex", "terminal", "global_basic"], ["local_repetition", "spacing"], ["dpc"]])
def test_blocks_equal_rows(table, names):
    features = [k for k, able in mergeable(make(names)).items() if able]
    want = {r.id: r for r in compute(table, make(names), features=features).collect()}
    out = compute_long(table, make(names), features=features, block=20)
    got = {r.id: r for r in out.collect()}
    assert out.columns == ["id", *features] and got.keys() == want.keys() and {t for c, t in out.dtypes if c != "id"} == {"double"}
    assert [(i, f, want[i][f], got[i][f]) for i in want for f in features if not same(want[i][f], got[i][f])] == []


def test_short_sequences_alone(spark):
    """No block of a task has a window."""
    rows = spark.createDataFrame([("a", ""), ("b", "AC")], "id string, sequence string").coalesce(1)
    for names in (["sliding_window"], ["run_blockiness"], ["local_repetition"]):
        features = [k for k, able in mergeable(make(names)).items() if able]
        want, got = ({r.id: r for r in f.collect()} for f in (compute(rows, make(names), features=features), compute_long(rows, make(names), features=features)))
        assert all(same(want[i][f], got[i][f]) for i in want for f in features)
    assert compute_long(rows.where("false"), make(["aac"])).collect() == []


def test_what_needs_whole_sequences_raises(table):
    with pytest.raises(ValueError, match="whole sequences"):
        compute_long(table, make(["spacing"])[0])
    with pytest.raises(ValueError, match="longer halo"):
        compute_long(table, REGISTRY["sliding_window"](window_sizes=(50,)), block=20)
    with pytest.raises(ValueError, match="no such"):
        compute_long(table, make(["aac"]), features=["nope"])


def test_a_long_sequence_spreads_over_tasks(spark):
    one = spark.range(1).selectExpr("'x' AS id", "repeat('ACDKWYKLLMRG', 100000) AS sequence")
    blocks = cut(one, block=5000, halo=100)
    dealt = blocks.repartition(8, "id", "at").rdd.mapPartitions(lambda rows: [sum(len(r.own) for r in rows)]).collect()
    assert sum(dealt) == 1_200_000 and max(dealt) < 400_000
    row = compute_blocks(blocks, make(["sliding_window", "run_blockiness"]), ["length", "sliding_window_win5_hydropathy_mean", "run_blockiness_charged_n_runs"], halo=100).first()
    want = compute(one, make(["sliding_window", "run_blockiness"]), features=["length", "sliding_window_win5_hydropathy_mean", "run_blockiness_charged_n_runs"]).first()
    assert all(same(a, b) for a, b in zip(want[1:], row[1:], strict=True))


@pytest.mark.parametrize("block", [7, 50, 10_000])
def test_fasta_in_blocks(spark, tmp_path, block):
    """Records over many splits, splits with many records, text before the first header, records without lines."""
    (tmp_path / "f").mkdir()
    for name in "ab":
        lines = ["what stands before"]
        for i in range(12):
            lines.append(f"  >{name}{i} some text" if i % 2 else f">{name}{i}")
            seq = "".join(R.choices(ALL.lower() + "*xß", k=R.choice([0, 3, 40, 900])))
            lines += [seq[j : j + 13] for j in range(0, len(seq), 13)] + [""]
        (tmp_path / "f" / f"{name}.fasta").write_text("\n".join(lines) if name == "a" else "\r\n".join(lines) + "\r\n", encoding="utf-8", newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    try:
        blocks = read_fasta_blocks(spark, str(tmp_path / "f"), block, min(block, 20)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = read_sequences(spark, str(tmp_path / "f/a.fasta")).unionByName(read_sequences(spark, str(tmp_path / "f/b.fasta")))
    want = cut(whole, block=block, halo=min(block, 20)).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, want)) and len(want) >= 24
    (tmp_path / "f/c.fasta").write_text(">a1\nACD\n")
    with pytest.raises(IdError):
        read_fasta_blocks(spark, str(tmp_path / "f"))
