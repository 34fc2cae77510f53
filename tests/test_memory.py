"""What the stages in Python hold at once: it must not grow with the residues of a batch."""

from __future__ import annotations

import gc
import random
import tracemalloc

import pyarrow as pa
import pytest

from aminoframe.functions.alphabet import RESIDUES
from aminoframe.functions.dialect import Dialect
from aminoframe.functions.states import Plan
from aminoframe.functions.vectors import stage
from aminoframe.plans.engine import features_of, make

SEQ = "".join(random.Random(1).choices(RESIDUES, k=20_000))


def peak_mb(run, batch):
    """Of a stage over one batch, without any help of the garbage collector."""
    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        for _ in run(iter([batch])):
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
        gc.enable()


@pytest.mark.parametrize("name", ["charge", "entropy_complexity", "global_basic", "sequence_order", "spacing", "structural_propensity", "hydrophobicity", "local_repetition", "sliding_window", "family_summary", "order_disorder"])
def test_a_batch_takes_no_more_memory_than_a_chunk(name):
    d = Dialect()
    features_of(d, make([name])[0])
    batch = pa.RecordBatch.from_pydict({"id": [str(i) for i in range(120)], "seq": [SEQ] * 120, "n": pa.array([len(SEQ)] * 120, pa.int32())})
    assert peak_mb(stage(d.recipes), batch) < 50


def test_words_of_neighbouring_blocks_are_counted_together():
    d = Dialect()
    features_of(d, make(["local_repetition"])[0])
    plan = Plan(d.recipes.only(lambda name: name.startswith("words")), (), 0)
    blocks = pa.RecordBatch.from_pydict({"id": ["x"] * 66 + ["y"], "at": [300 * i for i in range(66)] + [0], "own": [SEQ[300 * i : 300 * i + 300] for i in range(66)] + ["ACAC"], "halo": [SEQ[300 * i + 300 : 300 * i + 310] for i in range(66)] + [""]})
    found = {(r["id"], r["word"]): (r["c"], r["first"], r["last"]) for b in plan.word_stage()(iter([blocks])) for r in b.to_pylist() if r["k"] == 2}
    assert sum(b.num_rows for b in plan.word_stage()(iter([blocks])) if b.column(1)[0].as_py() == 2) == len(found) <= 402
    assert found["y", 1] == (2, 0, 2) and found["x", 1] == (sum(SEQ[i : i + 2] == "AC" for i in range(19_800)), SEQ.index("AC"), SEQ[:19_801].rindex("AC"))
    assert peak_mb(plan.stage(), blocks) < 50
