"""Secrets in texts: three base patterns, and what looks like them by the grammar of their formats.

Credentials that a base pattern found, labelled by its kind, make a prefix tree over character classes for each kind.  States
whose futures are statistically alike are merged (ALERGIA's test by Hoeffding's bound), which leaves a probabilistic
automaton: the grammar of the format.  Other long tokens make an automaton of ordinary tokens in the same way.  A candidate
is any long token; it is a finding of its own if a format explains it better than ordinary tokens do.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

# The base patterns, the kinds in their order, and the least lengths.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16
#: The kind of spans that the grammars add.
GRAMMAR = "grammar"

_KEYWORDS = (b"passw", b"secret", b"token", b"key")
_LONG = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_FOUND = "array<struct<kind:string,begin:int,end:int,value:string>>"
#: Symbols of tokens: digits, letters that hexadecimal numbers have, others, and each sign.
_CLASS = {c: "0" for c in "0123456789"} | {c: "a" for c in "abcdef"} | {c: "A" for c in "ABCDEF"} | {c: "z" for c in "ghijklmnopqrstuvwxyz"} | {c: "Z" for c in "GHIJKLMNOPQRSTUVWXYZ"}
SYMBOLS = tuple("0aAzZ+/_.=-")
_SYMBOL = str.maketrans(_CLASS)


def symbols(token: str) -> str:
    """A token's classes; one that has letters of one case only reads as lower-case."""
    return token.translate(_SYMBOL) if token != token.upper() else token.lower().translate(_SYMBOL)


def base_spans(text: str) -> tuple[list[tuple[str, int, int, str]], list[tuple[int, int, str]]]:
    """((kind, begin, end, value) by begin and kind, (begin, end, token) of all long tokens) of a text."""
    tokens = [(m.start(), m.end(), m[0]) for m in _LONG.finditer(text)]
    found = []
    lower = text.encode("utf-8", "surrogatepass").lower()
    if any(k in lower for k in _KEYWORDS):
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    #: Matches of the other two of the least length lie inside long tokens.
    for begin, _, token in tokens:
        if "AKIA" in token:
            found += [("access", begin + m.start(), begin + m.end(), m[0]) for m in ACCESS.finditer(token) if m.end() - m.start() >= ACCESS_LENGTH]
        found += [("hex", begin + m.start(), begin + m.end(), m[0]) for m in HEX.finditer(token) if m.end() - m.start() >= HEX_LENGTH]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0]))), tokens


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(base, other) of texts; ``other`` are the long tokens that no base span touches."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
    for batch in batches:
        base, other = [], []
        for text in batch.column(1):
            found, tokens = base_spans(text.as_py() or "")
            base.append([{"kind": k, "begin": b, "end": e, "value": v} for k, b, e, v in found])
            other.append([{"kind": "other", "begin": b, "end": e, "value": v} for b, e, v in tokens if not any(f[1] < e and b < f[2] for f in found)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(other, span)], names=["doc_id", "base", "other"])


@dataclass
class Grammar:
    """A probabilistic automaton: ``step[state][symbol]`` and the natural logarithms of the choices; "" ends a token."""

    step: list[dict[str, int]]
    log: list[dict[str, float]]
    unseen: list[float] = field(default_factory=list)
    #: The least likelihood a symbol among the words that it was inferred from.
    floor: float = -math.inf

    def likelihood(self, word: str) -> float:
        """Logarithm of a word's probability.  A choice that a state has never seen costs its reserve; reading goes on there."""
        state, total = 0, 0.0
        for symbol in (*word, ""):
            total += self.log[state].get(symbol, self.unseen[state])
            state = self.step[state].get(symbol, state)
        return total


def infer(words: Collection[tuple[str, int]], alpha: float = 0.01) -> Grammar:
    """Merges compatible states of the prefix tree of ``words`` (with counts), in breadth-first order.

    Two states are compatible if the frequencies of ending and of each symbol, and those after each symbol in turn, differ
    by less than Hoeffding's bound at confidence ``alpha``.  Probabilities are smoothed by one count for all choices.
    """
    step: list[dict[str, int]] = [{}]
    count: list[dict[str, int]] = [{}]
    for word, n in sorted(words):
        at = 0
        for symbol in word:
            count[at][symbol] = count[at].get(symbol, 0) + n
            if symbol not in step[at]:
                step[at][symbol] = len(step)
                step.append({})
                count.append({})
            at = step[at][symbol]
        count[at][""] = count[at].get("", 0) + n
    width = math.sqrt(0.5 * math.log(2 / alpha))

    def alike(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            nx, ny = sum(count[x].values()), sum(count[y].values())
            room = width * (1 / math.sqrt(nx) + 1 / math.sqrt(ny)) if nx and ny else math.inf
            if any(abs(count[x].get(s, 0) / nx - count[y].get(s, 0) / ny) > room for s in {*count[x], *count[y]} if room < math.inf):
                return False
            todo += [(step[x][s], step[y][s]) for s in step[x].keys() & step[y].keys()]
        return True

    def fold(red: int, blue: int, parent: int, symbol: str) -> None:
        step[parent][symbol] = red
        todo = [(red, blue)]
        while todo:
            x, y = todo.pop()
            for s, n in count[y].items():
                count[x][s] = count[x].get(s, 0) + n
            for s, to in step[y].items():
                if s in step[x]:
                    todo.append((step[x][s], to))
                else:
                    step[x][s] = to

    red = [0]
    #: A merge may give children to any state before it, so the next one to judge is looked for from the beginning.
    while edge := next(((r, symbol) for r in red for symbol in sorted(step[r]) if step[r][symbol] not in red), None):
        blue = step[edge[0]][edge[1]]
        same = next((r for r in red if alike(r, blue)), None)
        if same is None:
            red.append(blue)
        else:
            fold(same, blue, *edge)
    name = {state: i for i, state in enumerate(red)}
    choices = len(SYMBOLS) + 1
    logs, unseen = [], []
    for state in red:
        total = sum(count[state].values()) + 1
        logs.append({s: math.log((n + 1 / choices) / total) for s, n in count[state].items()})
        unseen.append(math.log(1 / choices / total))
    out = Grammar([{s: name[to] for s, to in step[state].items()} for state in red], logs, unseen)
    out.floor = min(out.likelihood(word) / (len(word) + 1) for word, _ in words)
    return out


@dataclass
class Scorer:
    formats: dict[str, Grammar]
    ordinary: Grammar

    def odds(self, token: str) -> float:
        """Logarithm of how much likelier the best format makes the token than the grammar of ordinary ones does.

        Only formats count in which the token is no stranger than any of those that they were inferred from.
        """
        word = symbols(token)
        fitting = [v for g in self.formats.values() if (v := g.likelihood(word)) >= g.floor * (len(word) + 1) - 1e-9]
        return max(fitting, default=-math.inf) - self.ordinary.likelihood(word)


def fit(scanned: DataFrame, sample: int = 2000, longest: int = 256) -> Scorer:
    """Grammars from at most ``sample`` different tokens of each kind, of up to ``longest`` characters: those with the smallest hashes."""
    out = {}
    for kind, column in ((*((k, "base") for k in KINDS), ("other", "other"))):
        values = scanned.select(F.explode(column).alias("f")).where((F.col("f.kind") == kind) & (F.length("f.value") <= longest)).select("f.value").distinct()
        chosen = [r.value for r in values.orderBy(F.xxhash64("value"), "value").limit(sample).collect()]
        shapes: dict[str, int] = {}
        for value in chosen:
            shapes[symbols(value)] = shapes.get(symbols(value), 0) + 1
        if shapes:
            out[kind] = infer(shapes.items())
    ordinary = out.pop("other", None) or infer([("z" * 16, 1)])
    return Scorer(out, ordinary)


def _report(scorer: Scorer, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            base, spans = [], []
            for found, other in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for i, kind in enumerate(KINDS):
                    counts[i].append(sum(f["kind"] == kind for f in found))
                base.append(",".join(f"{f['kind']}:{f['begin']}:{f['end']}" for f in found))
                more = [f | {"kind": GRAMMAR} for f in other if scorer.odds(f["value"]) >= least]
                both = sorted(found + more, key=lambda f: (f["begin"], (*KINDS, GRAMMAR).index(f["kind"])))
                spans.append(",".join(f"{f['kind']}:{f['begin']}:{f['end']}" for f in both))
            digests = [hashlib.sha256(b.encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def secret_spans(docs: DataFrame, least_odds: float = 12.0, sample: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Base spans are the base patterns' leftmost matches that don't overlap others of their kind and are long enough; they
    always stay.  Further spans, of kind ``grammar``, are tokens of 16 characters or more that no base span touches and
    whose log odds are ``least_odds`` or more.  Spans are ``kind:begin:end`` in code points, by begin, then kind.  Null and
    empty texts have none.  Rows that repeat are judged each; other columns are ignored.  Without any credential nothing
    is added.

    Texts are read once; grammars are fitted on ``sample`` tokens of a kind and score every candidate of every text.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scanned = Scratch(docs.sparkSession, "secrets").write(texts.mapInArrow(_scan, f"doc_id long, base {_FOUND}, other {_FOUND}"), "scanned")
    return scanned.mapInArrow(_report(fit(scanned, sample), least_odds), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def query(spark, sf_dir: str) -> DataFrame:
    return secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
