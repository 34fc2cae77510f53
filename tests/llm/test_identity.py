"""Texts that a polynomial hash modulo 2**64 can't tell apart, and texts of many pieces."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers as tokenizers_path
import pyarrow as pa
import pytest
from brute import contamination, substring
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from aminoframe.llm import decontaminate, quality, shingle_dedup, substring_dedup, token_counts, tokens_file
from aminoframe.llm.words import PLAIN_MASK, grams, words_of


def thue(n: int) -> tuple[str, str]:
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


ONE, TWO = thue(1024)
REST = " ".join(f"w{i}" for i in range(49))


@pytest.fixture(scope="module")
def twins(spark):
    return spark.createDataFrame([(1, ONE), (2, TWO), (3, f"{ONE} {REST}"), (4, f"{TWO} {REST}")], "doc_id long, text string").coalesce(1)


def test_counts_and_ids_of_twin_words(spark, twins):
    path = tokenizers_path.path("piece_bpe_32k.model")
    encoder = SentencePieceProcessor(model_file=path)
    rows = {r.doc_id: r for r in twins.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(twins, path).collect()} == {d: len(encoder.encode(r.text)) for d, r in rows.items()}
    path = tokenizers_path.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    found = tokens_file.read_token_files(spark, tokens_file.write_token_files(twins, path)).collect()
    for r in found:
        ids = np.array([*library.encode(rows[r.doc_id].text, add_special_tokens=False).ids, 2], "<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_twin_words_share_no_window(twins):
    assert {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(twins).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}


def test_twin_items(spark):
    docs = spark.createDataFrame([(1, f"{ONE} x"), (2, f"{TWO} x")], "doc_id long, text string")
    items = spark.createDataFrame([(1, f"{ONE} x"), (2, f"{TWO} x")], "item_id long, text string")
    found = {r.doc_id: [m.item_id for m in r.matches] for r in decontaminate.contamination(docs, items).collect()}
    assert found == {1: ["1"], 2: ["2"]}


def test_twin_runs_of_words():
    (a,), (b,) = (list(words_of(pa.array([" ".join(x)]), PLAIN_MASK)) for x in (ONE, TWO))
    assert grams(a.hash, 1024)[0] != grams(b.hash, 1024)[0]


@pytest.fixture(scope="module")
def long_rows():
    """Texts of several pieces, with passages at all distances from their ends."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdeé", k=r.randint(1, 9))) for _ in range(3000)]
    base = r.choices(words, k=420_000)
    other = r.choices(words, k=30_000)
    for _ in range(40):
        at, to, n = r.randrange(len(base) - 300), r.randrange(len(other) - 300), r.randint(45, 250)
        other[to : to + n] = base[at : at + n]
    return [(1, " ".join(other)), (2, " ".join(base)), (3, "\n".join(" ".join(base[i : i + 40]) for i in range(0, 200_000, 40))), (4, None), (5, "x" * 2_000_000 + " " + " ".join(other[:200]))]


def test_long_texts(spark, long_rows):
    docs = spark.createDataFrame(long_rows, "doc_id long, text string").repartition(3)
    got = substring_dedup.substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(substring(long_rows, 50))
    words = (long_rows[1][1]).split(" ")
    items = [(i, " ".join(words[at : at + n])) for i, (at, n) in enumerate([(7, 12), (200_000, 60), (419_980, 20), (100, 100_000)])] + [(9, words[5])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs, benchmark).mapInArrow(decontaminate._digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
    assert sorted(map(tuple, found.withColumn("c", F.col("n_hit") > 0).collect())) == sorted(contamination(long_rows, items))
    model, library = tokenizers_path.path("piece_bpe_32k.model"), tokenizers_path.path("byte_bpe_50k.json")
    encoder, tokenizer = SentencePieceProcessor(model_file=model), Tokenizer.from_file(library)
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, model).collect()} == {d: len(encoder.encode(t or "")) for d, t in long_rows}
    found = tokens_file.read_token_files(spark, tokens_file.write_token_files(docs, library)).collect()
    want = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in long_rows}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in found} == {d: (len(i), zlib.crc32(i.tobytes())) for d, i in want.items()}


def test_pieces_of_lines_and_shingles_add_up(long_rows, monkeypatch):
    column = pa.array([t for _, t in long_rows], pa.large_string())
    in_pieces = {x.lo: x for x in quality.lines_of(column)}, {row: s for row, _, s in shingle_dedup.shingle_sets(column, 5)}
    for module in (quality, shingle_dedup):
        monkeypatch.setattr(module, "words_of", lambda *a, **k: words_of(*a, **k | {"chunk_bytes": 1 << 40}))
    (whole,) = quality.lines_of(column)
    for row, got in in_pieces[0].items():
        for d in range(len(got.first) - 1):
            a, b = whole.first[row + d], whole.first[row + d + 1]
            assert np.allclose(got.x[got.first[d] : got.first[d + 1]], whole.x[a:b], atol=1e-6)
            assert (got.weight[got.first[d] : got.first[d + 1]] == whole.weight[a:b]).all()
    for row, _, s in shingle_dedup.shingle_sets(column, 5):
        assert (in_pieces[1][row] == s).all()


def test_repeated_rows_take_linear_time(spark):
    text = " ".join(f"w{i % 70}" for i in range(120))
    rows = [(1, text)] * 2_000 + [(None, text)] * 2_000 + [(2, text + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring_dedup.substring_dedup(docs).groupBy("doc_id", "n_removed").count().collect()
    assert {tuple(r) for r in got} == {(1, 0, 2_000), (None, 120, 2_000), (2, 120, 1)}


def test_no_factor_can_be_longer(spark, long_rows):
    docs = spark.createDataFrame(long_rows, "doc_id long, text string")
    words = {d: (t or "").split() for d, t in long_rows}
    checked = 0
    for r in substring_dedup.substring_dedup(docs).collect():
        for f in r.factors:
            mine, ref = words[r.doc_id], words[f.ref_id]
            assert mine[f.start : f.start + f.length] == ref[f.ref_start : f.ref_start + f.length]
            assert mine[f.start + f.length : f.start + f.length + 1] != ref[f.ref_start + f.length : f.ref_start + f.length + 1] or f.start + f.length == len(mine)
            checked += 1
    assert checked > 30
