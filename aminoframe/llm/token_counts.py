"""Token counts by batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .units import Units, pieces, safe_gaps

BATCH_BYTES = 4 << 20


def _before_spaces(data: np.ndarray) -> np.ndarray:
    return safe_gaps(data, 32)


class Counter:
    """Token counts of one vocabulary.

    No piece has a space mark after another character, so no merge reaches over the end of a word: at a single space
    between two characters that are surely neither spaces nor the mark a text may be parted, and the parts' counts add
    up.  Each distinct part (mostly a word) of a batch is encoded once, by its bytes; odd spacing stays inside a part.
    """

    def __init__(self, model: str, entries: int) -> None:
        self.encoder = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces_ = [self.encoder.id_to_piece(i) for i in range(self.encoder.vocab_size())]
        if any("▁" in p.lstrip("▁") for p in pieces_) or self.encoder.encode("a  ", out_type=str)[-1][-1] != "▁":
            raise ValueError("texts can't be split at spaces with this vocabulary")
        self.units = Units(entries)

    def lengths(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One value a unit.  One that begins inside a text has its space before it, which the encoder adds by itself."""
        found = self.encoder.encode([u[1:].decode() if u[:1] == b"\xff" else u.decode() for u in units], num_threads=1)
        return np.fromiter(map(len, found), np.uint32, len(found)), np.arange(len(found)), np.ones(len(found), np.int64)

    def count(self, data: np.ndarray, offsets: np.ndarray, goes_on: bool = False) -> np.ndarray:
        """Counts of the texts between neighbouring offsets; ``goes_on``: the first is parted text, from its space on."""
        cuts = safe_gaps(data, 32, offsets)
        if len(cuts) or goes_on:  # the space before an inner part becomes a byte that no text has
            data = data.copy()
            data[cuts] = 255
            data[:1] = 255 if goes_on else data[:1]
        counts, _, owners = self.units.values(data, cuts, offsets, self.lengths)
        return np.diff(np.r_[0, np.cumsum(counts, dtype=np.int64)][owners])


_COUNTERS: dict[str, Counter] = {}


def _count(model: str, batch_bytes: int, cache_entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _COUNTERS:
            _COUNTERS[model] = Counter(model, cache_entries)
        counter = _COUNTERS[model]
        for batch in batches:
            n_bytes, n_tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            goes_on = False
            for lo, data, offsets, more in pieces(batch.column(1), batch_bytes, _before_spaces):
                rows = slice(lo, lo + len(offsets) - 1)
                n_bytes[rows] += np.diff(offsets)
                n_tokens[rows] += counter.count(data, offsets, goes_on)
                goes_on = more
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str, limit: int = 4096, batch_bytes: int = BATCH_BYTES, cache_entries: int = 300_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``model`` is the path of a SentencePiece vocabulary.  Whole texts count, without begin and end tokens; null counts
    as empty, with 0 tokens.  Encoder calls take batches of about ``batch_bytes``; longer texts are parted at safe
    spaces (``Counter``), and only a part without any is encoded in one piece, whatever its length.  Each worker keeps
    the counts of at most ``cache_entries`` parts, plus those of one batch.  Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_count(model, batch_bytes, cache_entries), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
