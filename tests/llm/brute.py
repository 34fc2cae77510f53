"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import random
import re

import xxhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_words(text: str | None) -> list[str]:
    return [w for w in SPACE.split(text or "") if w]


def bench_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def substring(rows, window):
    first: dict[tuple, int] = {}
    words = [(d if d is not None else 1 << 63, plain_words(t)) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for (doc_id, _), (d, w) in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((doc_id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def fingerprint(text: str | None) -> int:
    w = plain_words(lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rows):
    prints = [(d, fingerprint(t)) for d, t in rows]
    group = list(range(len(prints)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                group[root(i)] = root(j)
    smallest: dict[int, int] = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            smallest[root(i)] = min(smallest.get(root(i), d), d)
    return [(d, f"{f:016x}", smallest.get(root(i))) for i, (d, f) in enumerate(prints)]


def contamination(rows, items, window=10):
    windows: dict[tuple, set[str]] = {}
    for name, text in items:
        w = bench_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(str(name))
    out = []
    for d, text in rows:
        w, hit, names = bench_words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    names |= found
        out.append((d, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return out


def lines(rows, threshold):
    def key(line):
        return lower(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))

    count: dict[str, int] = {}
    for _, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    out = []
    for d, text in rows:
        parts = (text or "").split("\n")
        kept = [x for x in parts if not (key(x) and count[key(x)] >= threshold)]
        out.append((d, len(parts), len(parts) - len(kept), sha("\n".join(kept))))
    return out


def texts(n: int, seed: int = 3, vocabulary: int = 400, longest: int = 260) -> list[tuple[int | None, str | None]]:
    """Rows with copies, near copies, shared passages and lines, nulls, empty and long texts, repeated rows."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéñß.,1") for _ in range(r.randint(1, 9))) for _ in range(vocabulary)]
    passage = [" ".join(r.choices(words, k=r.randint(40, 90))) for _ in range(6)]
    rows: list[tuple[int | None, str | None]] = []
    for i in range(n):
        kind = r.random()
        if kind < 0.12 and rows:
            rows.append((i, r.choice(rows)[1]))
        elif kind < 0.3 and rows and (old := r.choice(rows)[1]):
            w = old.split(" ")
            for _ in range(r.randint(1, 2)):
                w[r.randrange(len(w))] = r.choice(words).upper()
            rows.append((i, " ".join(w)))
        else:
            parts = [" ".join(r.choices(words, k=r.randint(1, longest // 2)))]
            if r.random() < 0.5:
                parts += [r.choice(passage), "Shared line %d " % r.randrange(4)]
            parts += [" ".join(r.choices(words, k=r.randint(0, longest // 2)))]
            rows.append((i, r.choice(["\n", " ", "\t \n"]).join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "one two"), (None, "no id at all"), (None, None)]
    rows += [(n + 5, " ".join(r.choices(words, k=30_000))), (n + 6, "x " * 3000), (n + 7, "x " * 3000 + "y"), rows[0], rows[0]]
    r.shuffle(rows)
    return rows
