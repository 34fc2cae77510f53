"""Collocations: phrases that occur more often than their parts would have it.

A shard (some megabytes of text) becomes a generalised suffix automaton over its words, bounded in depth: every string of
up to ``max_words`` words of a piece, with the number of its end positions, and a suffix link to the string without its
first word.  Strings with the same end positions are one state and are listed from it.  Counts are then summed over all
shards by Spark.

Strings of three and more words are listed in a pass of their own each: only those whose prefix and suffix link, a word
shorter, reach the least frequency in all shards together, as no others can.  Tasks know these by a bitmap of bounded size;
a wrong yes costs a row and is dropped by the sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, settings
from .words import Words, words_of

#: Bytes that end a piece (``[.,;:!?\x0A-\x0D]``), and those that a word can't have.
PIECE_END = np.zeros(256, dtype=bool)
PIECE_END[[*b".,;:!?\n\x0b\x0c\r"]] = True
WORD = ~PIECE_END
WORD[[9, 32]] = False
SHARD_BYTES = 2 << 20
#: Bits of the bitmap of frequent strings, as powers of two; so many for each string, within the bounds.
BITS_LOW, BITS_HIGH, BITS_EACH = 20, 28, 16
#: First parts of a language's ranking, so that it is never sorted by one task.
RANK_PARTS = 16


class Automaton:
    """Strings of 1, 2, ... words of a shard.

    ``of[d - 1]`` has for each word the number of the string of d words that begins there, or -1; ``count``, ``place`` and
    ``link`` have for each string the number of its end positions, where it stands, and the string that is left without
    its first word.  Words told apart by language make strings of one language only.
    """

    def __init__(self, symbols: np.ndarray, piece: np.ndarray, again: int = 0) -> None:
        """``again``: so many first words have been read before; what ends there has been counted."""
        self.piece, self.fresh = piece, np.arange(len(piece)) >= again
        self.of: list[np.ndarray] = []
        self.count: list[np.ndarray] = []
        self.place: list[np.ndarray] = []
        self.link: list[np.ndarray] = []
        self._level(symbols, np.arange(len(symbols)))

    def _level(self, keys: np.ndarray, at: np.ndarray) -> None:
        d = len(self.of) + 1
        numbers, distinct = pd.factorize(keys)
        of, place = np.full(len(self.piece), -1, dtype=np.int64), np.empty(len(distinct), dtype=np.int64)
        of[at] = numbers
        place[numbers[::-1]] = at[::-1]
        self.of.append(of)
        self.place.append(place)
        self.count.append(np.bincount(numbers[self.fresh[at + d - 1]], minlength=len(distinct)))
        self.link.append(self.of[-2][place + 1] if d > 1 else np.full(len(distinct), -1, dtype=np.int64))

    def deepen(self, kept: np.ndarray | None = None) -> None:
        """Adds the strings of one more word, of two kept ones each if ``kept`` tells which strings of the last level count."""
        d, last = len(self.of) + 1, self.of[-1]
        at = np.flatnonzero(self.piece[: max(0, len(self.piece) - d + 1)] == self.piece[d - 1 :])
        if kept is not None and len(at):
            at = at[kept[last[at]] & kept[last[at + 1]]]
        self._level(last[at] * max(1, len(self.count[0])) + self.of[0][at + d - 1], at)

    def states(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, strings, counts), every string once: of each state its longest string, then along suffix links."""
        for d in range(len(self.of), 0, -1):
            longest = np.ones(len(self.count[d - 1]), dtype=bool)
            if d < len(self.of):
                up = self.link[d]
                longest[up[self.count[d] == self.count[d - 1][up]]] = False
            strings = np.flatnonzero(longest)
            for e in range(d, 0, -1):
                n = self.count[e - 1][strings]
                yield e, strings[n > 0], n[n > 0]
                if e == 1:
                    break
                up = self.link[e - 1][strings]
                strings = up[self.count[e - 2][up] == n]


class _Shard:
    """An automaton with the spellings and languages of its strings."""

    def __init__(self, w: Words, langs: pa.Array) -> None:
        doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        known = langs.slice(w.lo, len(w.first) - 1).dictionary_encode()
        self.w, self.doc, self.langs = w, doc, known
        lang = known.indices.to_numpy(zero_copy_only=False)[doc].astype(np.int64)
        piece = np.cumsum(PIECE_END[w.data], dtype=np.int32)[w.start] + doc
        self.automaton = Automaton(lang * max(1, len(w.spelling)) + w.number, piece, w.again)
        self.words = w.spelling.cast(pa.large_string())

    def spelled(self, d: int, strings: np.ndarray) -> tuple[pa.Array, pa.Array]:
        at = self.automaton.place[d - 1][strings]
        parts = [self.words.take(pa.array(self.w.number[at + j])) for j in range(d)]
        lang = self.langs.dictionary.take(self.langs.indices.take(pa.array(self.doc[at])))
        return lang, pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if d > 1 else parts[0]

    def rows(self, d: int, strings: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        lang, phrase = self.spelled(d, strings)
        return pa.RecordBatch.from_arrays([lang.cast(pa.string()), phrase.cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "phrase", "n"])


def _hashes(lang: pa.Array, phrase: pa.Array, bits: int) -> np.ndarray:
    """A place in the bitmap for each string."""
    out, step = np.empty(len(phrase), dtype=np.uint64), 1 << 15
    for lo in range(0, len(out), step):
        whole = pc.binary_join_element_wise(lang[lo : lo + step].cast(pa.large_string()), phrase[lo : lo + step].cast(pa.large_string()), pa.scalar("\n", pa.large_string())).cast(pa.large_binary())
        out[lo : lo + step] = np.fromiter(map(xxhash.xxh3_64_intdigest, whole.to_pylist()), np.uint64, len(whole))
    return out >> np.uint64(64 - bits)


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int, overlap: int) -> Iterator[_Shard]:
    for batch in batches:
        for w in words_of(batch.column(1), WORD, fold=True, chunk_bytes=shard_bytes, overlap=overlap):
            if len(w.start):
                yield _Shard(w, batch.column(0))


def _short(depth: int, shard_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, phrase, n) of all strings of a shard; of the empty string, the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, shard_bytes, depth - 1):
            one = shard.automaton
            for _ in range(1, depth):
                one.deepen()
            for d, strings, counts in one.states():
                yield shard.rows(d, strings, counts)
            langs = np.bincount(shard.langs.indices.to_numpy(zero_copy_only=False)[shard.doc[one.fresh]], minlength=len(shard.langs.dictionary))
            yield pa.RecordBatch.from_arrays([shard.langs.dictionary.cast(pa.string()), pa.array([""] * len(langs), pa.string()), pa.array(langs, pa.int64())], names=["lang", "phrase", "n"])

    return run


def _deep(depth: int, shard_bytes: int, bitmap, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, phrase, n) of the strings of ``depth`` words whose two parts a word shorter are in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bitmap.value, dtype=np.uint8)
        for shard in _shards(batches, shard_bytes, depth - 1):
            one = shard.automaton
            for _ in range(2, depth):
                one.deepen()
            h = _hashes(*shard.spelled(depth - 1, np.arange(len(one.count[-1]))), bits)
            one.deepen((table[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 == 1)
            n = one.count[-1]
            yield shard.rows(depth, np.flatnonzero(n), n[n > 0])

    return run


def _bitmap(strings: DataFrame, bits: int) -> bytes:
    """Little-endian bitmap of hashed (lang, phrase); at most 32 MB, whatever the table's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.unique(_hashes(batch.column(0), batch.column(1), bits))
            cell, begin = np.unique(h >> np.uint64(6), return_index=True)
            bit = np.left_shift(np.uint64(1), h & np.uint64(63))
            value = np.bitwise_or.reduceat(bit, begin) if len(h) else bit
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(value.view(np.int64))], names=["cell", "bits"])

    found = strings.mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), dtype=np.int64)
    table[found.column("cell").to_numpy()] = found.column("bits").to_numpy()
    return table.tobytes()


def phrase_counts(docs: DataFrame, max_words: int = 3, least: int = 10, lang_col: str = "lang", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, phrase, n) of all phrases of up to ``max_words`` words that occur ``least`` times or more.

    Phrase "" has each language's number of words.  Texts are lower-cased in A-Z, cut into pieces at ``.,;:!?`` and line
    ends and into words at spaces and tabs; null texts have no words, a null language is ``und``.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession, "phrases")

    def frequent(rows: DataFrame) -> DataFrame:
        total = rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": "16m"}):
            return scratch.write(total.where((F.col("n") >= least) | (F.col("phrase") == "")), "frequent")

    schema = "lang string, phrase string, n long"
    found = last = frequent(texts.mapInArrow(_short(min(2, max_words), shard_bytes), schema))
    for depth in range(3, max_words + 1):
        last = last.where(F.size(F.split("phrase", " ")) == depth - 1)
        bits = min(BITS_HIGH, max(BITS_LOW, (BITS_EACH * max(1, last.count())).bit_length()))
        bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(last.select("lang", "phrase"), bits))
        last = frequent(texts.mapInArrow(_deep(depth, shard_bytes, bitmap, bits), schema))
        found = found.unionByName(last)
    return found


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, top: int = 2000, within: int = 50, lang_col: str = "lang", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``max_words`` words.

    ``a`` is how often the phrase occurs, at least ``least`` times; ``l`` and ``r`` are those of its two parts at the cut
    with the lowest score floor(10^6 a a / (l r)), the first of equal ones; ``n`` counts the language's words.  A phrase
    goes if a longer one with ``within`` per cent of its occurrences or more holds it.  One longer by a word decides
    that: any longer one around it holds such a one, which occurs at least as often.  These are the strings whose suffix
    link or prefix the phrase is.  Order: score and ``a`` descending, phrase by its bytes.

    A language without such phrases has no rows; an empty table gives none.  Rows that repeat count each.  Other columns
    are ignored.  No task sorts a language: its ranking is taken of RANK_PARTS rankings.
    """
    if max_words < 2 or least < 1:
        raise ValueError("phrases have two words or more and occur at least once")
    counted = phrase_counts(docs, max_words, least, lang_col, text_col, shard_bytes)
    words = F.split("phrase", " ")
    phrases = counted.where(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("n").alias("a"), words.alias("words"))
    part = lambda begin, size: F.array_join(F.slice("words", begin, size), " ")
    cut = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    sides = F.explode(F.array(F.struct(F.lit(True).alias("left"), part(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("left"), part(F.col("k") + 1, F.size("words")).alias("part")))).alias("side")
    parts = phrases.select("lang", "phrase", "a", "words", cut).select("lang", "phrase", "a", "k", sides).select("lang", "phrase", "a", "k", "side.left", "side.part")
    known = parts.join(counted.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")), ["lang", "part"])
    at = [F.max(F.when((F.col("k") == k) & (F.col("left") == left), F.col("f"))).alias(f"{'l' if left else 'r'}{k}") for k in range(1, max_words) for left in (True, False)]
    cuts = known.groupBy("lang", "phrase", "a").agg(*at)
    scores = [F.when(F.col(f"l{k}").isNotNull(), F.expr(f"struct((cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * 1000000BD) div (cast(l{k} as decimal(16,0)) * cast(r{k} as decimal(16,0))) as score, {k} as k, l{k} as l, r{k} as r)")) for k in range(1, max_words)]
    scored = cuts.select("lang", "phrase", "a", (F.least(*scores) if len(scores) > 1 else scores[0]).alias("best"))
    links = F.explode(F.array(part(F.lit(2), F.size("words")), part(F.lit(1), F.size("words") - 1))).alias("phrase")
    longer = phrases.where(F.size("words") > 2).select("lang", "a", links).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < within * F.col("a")))
    rows = kept.select("lang", "phrase", "a", "best.score", "best.l", "best.r")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    sizes = counted.where("phrase = ''").select("lang", "n")
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


#: The same in DuckDB, from all words of all pieces; products in 128-bit integers.
SQL = r"""
    WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
    n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
    place AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 4) AS ks(k) WHERE len(w) >= k),
    f AS (SELECT lang, k, g, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM place) GROUP BY ALL HAVING count(*) >= 10),
    c AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1),
    cut AS (SELECT lang, g, a, i AS k, array_to_string(w[1:i], ' ') AS lg, array_to_string(w[i + 1:k], ' ') AS rg FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
    scored AS (
        SELECT cut.lang, cut.g, a, cut.k, l.f AS l, r.f AS r, (1000000 * a::HUGEINT * a::HUGEINT // (l.f::HUGEINT * r.f::HUGEINT))::BIGINT AS score
        FROM cut JOIN f l ON l.lang = cut.lang AND l.g = lg JOIN f r ON r.lang = cut.lang AND r.g = rg
    ),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM scored) WHERE o = 1),
    held AS (
        SELECT DISTINCT c.lang, c.g
        FROM c JOIN (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS g FROM c WHERE k = 3) t ON c.lang = t.lang AND c.g = t.g
        WHERE 100 * t.a >= 50 * c.a
    )
    SELECT lang, rank, phrase, a, l, r, n, score
    FROM (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
        FROM (SELECT lang, g AS phrase, a, l, r, score FROM best ANTI JOIN held USING (lang, g))
    ) JOIN n USING (lang) WHERE rank <= 2000"""
