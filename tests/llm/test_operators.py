from __future__ import annotations

import io
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as tokenizers_path
import pyarrow as pa
import pytest
from brute import contamination, fingerprint, lines, near, sha, substring, texts
from pyspark.sql import functions as F

from aminoframe.llm import components, decontaminate, exact_dedup, html_text, line_dedup, mixing, quality, simhash_dedup, substring_dedup, token_counts, tokens_file
from aminoframe.llm.units import pieces

SCHEMA = "doc_id long, text string, id string, spans int, source string, n_words int"


@pytest.fixture(scope="module")
def rows():
    return texts(150)


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Extra columns have the names that operators use inside."""
    return spark.createDataFrame([(d, t, "x", 1, None if i % 7 == 0 else f"s{i % 3}", 5) for i, (d, t) in enumerate(rows)], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(found):
    return sorted((tuple(x) for x in found), key=repr)


@pytest.mark.parametrize("window", [20, 50])
def test_substrings(docs, rows, window):
    got = substring_dedup.substring_dedup(docs, window).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert ordered(got) == ordered(substring(rows, window))


def test_substring_factors_point_at_the_same_words(docs, rows):
    found = {r.doc_id: r for r in substring_dedup.substring_dedup(docs, 20).where("doc_id is not null").collect()}
    words = {d: (t or "").split() for d, t in rows}
    factors = [(d, f) for d, r in found.items() for f in r.factors]
    assert len(factors) > 20
    for d, f in factors:
        assert f.ref_id < d and f.length >= 20
        assert words[d][f.start : f.start + f.length] == words[f.ref_id][f.ref_start : f.ref_start + f.length]


def test_near_duplicates(docs, rows):
    got = simhash_dedup.simhash_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    assert ordered(got) == ordered(near(rows))
    kept = simhash_dedup.simhash_dedup(docs)
    assert kept.columns == docs.columns
    want = Counter(d for d, _, c in near(rows) if d is not None and d == c)
    assert Counter(r.doc_id for r in kept.collect() if r.doc_id is not None) == want


def test_posting_lists_find_every_pair(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(40)]
    values = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 3))) for b in base for _ in range(8)}
    distinct = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    links = {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash_dedup.near_links(distinct).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in links)

    def groups(pairs):
        label = {v: v for v in values}

        def root(v):
            while label[v] != v:
                v = label[v]
            return v

        for a, b in pairs:
            label[root(a)] = root(b)
        out: dict[int, set] = {}
        for v in values:
            out.setdefault(root(v), set()).add(v)
        return sorted(map(sorted, out.values()))

    assert groups(links) == groups((a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2)


def test_hot_lists_lose_no_pair(spark):
    """Thousands of fingerprints that share four or six bytes: none of their lists is paired in full."""
    r = random.Random(2)
    values = {0x0102030400000000 | r.getrandbits(12) for _ in range(1500)} | {0x0102030405060000 | r.getrandbits(16) for _ in range(400)}
    values |= {v ^ 1 << r.randrange(64) for v in list(values)[:200]}
    distinct = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    found = components.components(simhash_dedup.near_links(distinct)).collect()
    label = {v: v for v in values}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for a in values:
        for k in range(64):
            for j in range(k, 64):
                b = a ^ (1 << k) ^ ((1 << j) if j > k else 0)
                if b in label and root(a) != root(b):
                    label[max(root(a), root(b))] = min(root(a), root(b))
    roots = {x.node % (1 << 64): x.root % (1 << 64) for x in found}

    def groups(name):
        out = {}
        for v in values:
            out.setdefault(name(v), set()).add(v)
        return sorted(map(sorted, out.values()))

    assert groups(lambda v: roots.get(v, v)) == groups(root)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    assert {r.node: r.root for r in components.components(links).collect()} == {**{i: 0 for i in range(1, 201)}, 501: 500}


def test_token_counts(docs, rows):
    path = tokenizers_path.path("piece_bpe_32k.model")
    encoder = token_counts.Counter(path, 10).encoder
    want = [(d, len((t or "").encode()), n := len(encoder.encode(t or "")), n > 4096) for d, t in rows]
    for entries in (5, 1_000_000):
        token_counts._COUNTERS.clear()
        assert ordered(token_counts.token_counts(docs, path, cache_entries=entries).collect()) == ordered(want)


ODD = ["", " ", "  ", "a ", " a", "a  b", "\n", " \n ", "a\n\n b", "▁", "a▁ b", "<s> a </s>", "<|endoftext|>x", "it's 'd ''s", "\ta\t\t b", "a\r\nb", "日本 語", "½ a²", "a\x00 b", "×3 é÷2", "ab1.c,, d—e"]


def _odd():
    r = random.Random(5)
    return ODD + ["".join(r.choice(" ab\n's1.é\t—“ª<|▁") for _ in range(r.randint(0, 12))) for _ in range(4000)]


@pytest.mark.parametrize("size", [15, 2000, 1 << 20])
def test_encoders_match_the_libraries_on_odd_texts(size):
    """Also when texts are parted wherever they may be."""
    odd = _odd()
    data = pa.array(odd, pa.large_string())
    counter, encoder = token_counts.Counter(tokenizers_path.path("piece_bpe_32k.model"), 50), tokens_file.Encoder(tokenizers_path.path("byte_bpe_50k.json"), 50)
    counts, ids, goes_on = np.zeros(len(odd), int), [[] for _ in odd], False
    for lo, raw, offsets, more in pieces(data, size, token_counts._before_spaces):
        counts[lo : lo + len(offsets) - 1] += counter.count(raw, offsets, goes_on)
        goes_on = more
    for lo, raw, offsets, _ in pieces(data, size, tokens_file._joints):
        flat, n = encoder.encode(raw, offsets)
        cuts = np.r_[0, np.cumsum(n)]
        for d in range(len(n)):
            ids[lo + d] += flat[cuts[d] : cuts[d + 1]].tolist()
    assert counts.tolist() == [len(x) for x in counter.encoder.encode(odd)]
    assert ids == [e.ids for e in encoder.tokenizer.encode_batch(odd, add_special_tokens=False)]


def _benchmark(spark, rows):
    words = [t for _, t in rows if t and len(t.split()) > 60]
    items = [(1, " ".join(words[0].split()[5:30])), (2, words[1].upper()), (30, "one"), (4, "one two!"), (5, None), (6, ""), (7, words[2]), (7, " ".join(words[3].split()[:12])), (None, words[4])]
    return items, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("block_bytes", [1 << 23, 300])
def test_contamination(spark, docs, rows, block_bytes):
    items, benchmark = _benchmark(spark, rows)
    found = decontaminate.contamination(docs, benchmark, block_bytes=block_bytes).mapInArrow(decontaminate._digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
    want = contamination(rows, [("" if i is None else i, t) for i, t in items])
    assert ordered(found.withColumn("contaminated", F.col("n_hit") > 0).collect()) == ordered(want)
    clean = decontaminate.decontaminate(docs, benchmark, block_bytes=block_bytes)
    assert clean.columns == docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(w[0] for w in want if not w[-1])


def test_longest_matches_and_their_places(spark):
    docs = spark.createDataFrame([(1, "x y " + " ".join(f"w{i}" for i in range(25)) + " z")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(9, "q " + " ".join(f"W{i}" for i in range(25)))], "item_id long, text string")
    (m,) = decontaminate.contamination(docs, benchmark).first().matches
    assert (m.start, m.length, m.item_id, m.item_start) == (2, 25, "9", 1)


def test_exact(docs, rows):
    import re

    text = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, (_, t) in enumerate(rows)}
    groups: dict[str, list] = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(text[i], []).append(d)
    want = []
    for i, (d, _) in enumerate(rows):
        group = groups[text[i]]
        keep = min((x for x in group if x is not None), default=None)
        want.append((d, keep, len(group), d == keep, sha(text[i])))
    assert ordered(exact_dedup.exact_dedup(docs).collect()) == ordered(want)


def test_exact_state_goes_on_over_batches(spark):
    dedup = exact_dedup.ExactDedup(spark)
    for batch in ([(5, "a  b"), (6, "c")], [(2, "a b"), (7, "a\nb")], [(9, "d")]):
        dedup.add(spark.createDataFrame(batch, "doc_id long, text string"))
    assert {r.keep_id: r.group_size for r in dedup.groups().collect()} == {2: 3, 6: 1, 9: 1}


def test_exact_is_native(docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_mixing(spark):
    rows = [(i, f"text {i}" * (1 + i % 3), "big" if i % 10 else "small", 3) for i in range(6000)] + [(None, None, None, 1), (7000, "", "big", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_copies int").repartition(4)
    rates = {r.source: r.rate for r in mixing.source_rates(docs, {"big": 0.5, "small": 0.5}).collect()}
    assert rates["small"] > 4 and rates[None] == 0
    mixed = mixing.mix_sources(docs, {"big": 0.5, "small": 0.5})
    got = mixed.collect()
    assert mixed.columns == ["doc_id", "text", "source", "n_copies", "n_copies_", "copy"]
    per_doc = Counter(r.doc_id for r in got)
    assert all(per_doc[r.doc_id] == r.n_copies_ and 1 <= r.copy <= r.n_copies_ for r in got)
    small = [per_doc.get(i, 0) for i in range(0, 6000, 10)]
    assert abs(np.mean(small) / rates["small"] - 1) < 0.1 and abs(np.var(small) / rates["small"] - 1) < 0.25
    size = Counter()
    for r in got:
        size[r.source] += len(r.text)
    assert abs(size["small"] / sum(size.values()) - 0.5) < 0.05
    assert ordered(mixing.mix_sources(docs.repartition(7), {"big": 0.5, "small": 0.5}).collect()) == ordered(got)
    assert [r.doc_id for r in got] != sorted(r.doc_id for r in got)


def test_mixing_with_many_sources_or_large_rates(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * (1000 if i else 1), f"s{i}") for i in range(60)], "doc_id long, text string, source string")
    one = ordered(mixing.mix_sources(docs).collect())
    monkeypatch.setattr(mixing, "MAX_LISTED_SOURCES", 3)
    assert ordered(mixing.mix_sources(docs).collect()) == one
    assert max(Counter(r[0] for r in one).values()) > 16


def _labelled(n, seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        good = r.random() < 0.7
        text = "\n".join(" ".join("".join(r.choice("abcde") for _ in range(r.randint(2, 7))) + ("" if good else r.choice(["$$$", "***"])) for _ in range(r.randint(3, 12))) + "." for _ in range(r.randint(1, 6)))
        rows.append((i, text, int(good)))
    return rows


def test_quality_on_the_held_out_fold(spark):
    rows = _labelled(600) + [(1000, None, None), (1001, "", 1), (1002, "x " * 20000, None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (99999, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.quality_scores(docs, model).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows[:600]}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert ordered(quality.quality_scores(docs, quality.fit(docs, flipped)).collect()) == ordered(got)


def test_line_features_are_of_the_text_alone():
    texts = ["x x x x x x x", "x x x x", "", "a b c d e a b c", "d e a b c d e", "x"]
    together = [(l.x, l.first) for l in quality.lines_of(pa.array(texts))][0]
    for i, t in enumerate(texts):
        (alone,) = quality.lines_of(pa.array([t]))
        assert np.array_equal(alone.x, together[0][together[1][i] : together[1][i + 1]])


def test_quality_training_is_bounded(spark):
    rows = _labelled(60)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    repeated = spark.createDataFrame([r[:2] for r in rows + rows] + [(rows[0][0], rows[0][1] + " more")], "doc_id long, text string").repartition(3)
    model, again = quality.fit(docs, labels), quality.fit(repeated, labels)
    assert np.array_equal(model.weights, again.weights) and np.array_equal(model.move, again.move)
    free = spark.createDataFrame([r[:2] for r in rows if r[1].count("\n") < 3], "doc_id long, text string")
    assert np.array_equal(quality.fit(docs, labels, train_lines=3).weights, quality.fit(free, labels).weights)
    assert quality.fit(docs, labels, train_lines=0) is None


def test_forward_backward_is_exact():
    r = np.random.default_rng(0)
    first, score, move = np.array([0, 1, 4, 6]), r.normal(size=6), np.exp(r.normal(size=(2, 2)))
    good, pairs = quality._chain(score, first, move, pairs=True)
    want, want_pairs = np.zeros(6), np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:], strict=True):
        total, marginal, joint = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for code in range(1 << (b - a)):
            y = [code >> i & 1 for i in range(b - a)]
            p = np.exp(sum(score[a + i] * y[i] for i in range(b - a))) * np.prod([move[y[i], y[i + 1]] for i in range(b - a - 1)])
            total += p
            marginal += p * np.array(y)
            for i in range(b - a - 1):
                joint[y[i], y[i + 1]] += p
        want[a:b], want_pairs = marginal / total, want_pairs + joint / total
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs)


@pytest.mark.parametrize("sent", [10**6, 0])
def test_lines(spark, docs, rows, sent, monkeypatch):
    monkeypatch.setattr(line_dedup, "SENT_KEYS", sent)
    index = line_dedup.LineDedupIndex(spark, threshold=3)
    index.insert(docs)
    got = index.apply(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()
    assert ordered(got) == ordered(lines(rows, 3))


def test_line_index_is_reversible(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    half = docs.where("doc_id % 2 = 0")
    index = line_dedup.LineDedupIndex(spark, threshold=3)
    index.insert(half)
    before = ordered(index.counts().collect())
    index.insert(docs.where("doc_id % 2 = 1 or doc_id is null"))
    assert ordered(index.apply(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()) == ordered(lines(rows, 3))
    index.delete(docs.where("doc_id % 2 = 1 or doc_id is null"))
    assert ordered(index.counts().collect()) == before
    kept = [(d, t) for d, t in rows if d is not None and d % 2 == 0]
    assert ordered(index.apply(half).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()) == ordered(lines(kept, 3))


def test_cuckoo_filter():
    r = np.random.default_rng(0)
    keys, others = (r.integers(0, 2**64, 4000, dtype=np.uint64) for _ in range(2))
    f = line_dedup.CuckooFilter(4000)
    assert f.add(keys) and f.contains(keys).all() and f.contains(others).mean() < 0.01
    f.remove(keys[:2000])
    assert f.contains(keys[2000:]).all() and f.contains(keys[:2000]).mean() < 0.01


def test_token_files(spark, docs, rows):
    path = tokenizers_path.path("byte_bpe_50k.json")
    manifest = tokens_file.write_token_files(docs, path)
    got = tokens_file.read_token_files(spark, manifest).orderBy("start").collect()
    encoder = tokens_file.Encoder(path)
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [2])
    order = [r.doc_id for r in got]
    assert order == sorted((d for d, _ in rows), key=lambda d: -1 if d is None else d)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    want = Counter((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, all_ids in ids.items() for x in all_ids)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    some = [3, 10, 11, rows[0][0], 10**9]
    wanted = spark.createDataFrame([(d,) for d in some], "doc_id long")
    read = tokens_file.read_documents(manifest, wanted).collect()
    assert ordered((r.doc_id, r.ids) for r in read) == ordered((d, x) for d in set(some) if d is not None for x in ids.get(d, []))


def test_frames_are_independent_and_checked():
    out = io.BytesIO()
    writer = tokens_file.Writer(out, frame_ids=10)
    parts = [np.arange(n, dtype="<u4") for n in (0, 4, 7, 30, 2)]
    for i, p in enumerate(parts):
        writer.add(i, p.tobytes())
    writer.close()
    raw = bytearray(out.getvalue())

    class Source(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            Source.read_bytes += n
            return super().read(n)

    reader = tokens_file.Reader(Source(bytes(raw)))
    before = Source.read_bytes
    assert reader.ids(4).tolist() == [0, 1] and Source.read_bytes - before == int(reader.table[reader.docs[4]["frame"], 0])
    assert [reader.ids(i).tolist() for i in range(5)] == [p.tolist() for p in parts]
    import zstandard

    first = zstandard.ZstdDecompressor().decompress(bytes(raw[: int(reader.table[0, 0])]))
    assert first == np.concatenate(parts[:2]).tobytes()
    table_at = len(raw) - 9 - 12 * len(reader.table)
    raw[table_at + 8] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        tokens_file.Reader(io.BytesIO(bytes(raw))).ids(1)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header class=top><a href=/>Site</a></header>
<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>Sports</a></li></ul></nav><div class="cookie-notice">We use cookies, please agree to all of them.</div>
<main><article><h1>A &amp; B</h1><p>First   paragraph with a <a href=/x>link</a> in it and <b>bold</b> words.<br>
<p>Second paragraph, not closed, &#233;t&eacute;<div class="ad-banner"><p>Buy now, it is cheap.</p></div><ul><li>point one of the list</li><li>point two</li></ul>
<form><input><label>Name</label></form><script>var x = "<p>no</p>";</script></article></main>
<section id=comments><p>I do not agree with any of this at all.</p></section><aside>Related things to read</aside><footer>&copy; 2020</footer>"""


def test_html():
    want = "A & B\nFirst paragraph with a link in it and bold words.\nSecond paragraph, not closed, été\npoint one of the list\npoint two"
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text("") == "" and html_text.main_text("<nav>only a menu</nav>") == ""
    assert html_text.main_text("just some words, no markup") == "just some words, no markup"
    assert html_text.main_text("a < b <p>and more words") != ""


def test_html_names_are_evidence():
    body = "".join(f"<p>Sentence number {i} tells what the council did about the bridge.</p>" for i in range(8))
    for name in ("layout has-sidebar", "no-sidebar"):
        assert html_text.main_text(f"<div class='{name}'><h1>Title</h1>{body}</div>").count("\n") == 8
    for head in ("header", "div"):
        assert html_text.main_text(f"<article><{head} class=entry-header><h1>Title</h1></{head}>{body}</article>").startswith("Title\n")
    got = html_text.main_text(f"<div><ul><li class=ad>Buy this now</ul></div><div>{body}</div>")
    assert got.count("Sentence") == 8 and "Buy" not in got
    assert "agree" not in html_text.main_text(f"<article>{body}</article><div id=comments><article class=comment><p>I do not agree.</p></article></div>")


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (None, "v", "", "z"), (1, "u", PAGE, "x"), (3, "w", "<p>" + "long words " * 50_000, "q")], "page_id long, url string, html string, text string")
    got = html_text.extract_text(pages).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 2] == [""]


def test_empty_tables(spark, none):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert substring_dedup.substring_dedup(none).count() == 0
    assert simhash_dedup.simhash_components(none).count() == 0 and simhash_dedup.simhash_dedup(none).count() == 0
    assert token_counts.token_counts(none, tokenizers_path.path("piece_bpe_32k.model")).count() == 0
    assert decontaminate.contamination(none, benchmark).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert mixing.mix_sources(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_scores(none, quality.fit(none, labels)).count() == 0
    index = line_dedup.LineDedupIndex(spark)
    index.insert(none)
    assert index.apply(none).count() == 0
    path = tokenizers_path.path("byte_bpe_50k.json")
    assert tokens_file.read_token_files(spark, tokens_file.write_token_files(none, path)).count() == 0
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_no_benchmark_leaves_all(spark, docs, rows):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, empty).count() == len(rows)
    assert {r.n_hit for r in decontaminate.contamination(docs, empty).mapInArrow(decontaminate._digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string").collect()} == {0}


def test_fingerprint_of_any_text():
    for text in ("", "One", "one TWO", "a b c", "É é à x", "a " * 70_000):
        assert simhash_dedup.fingerprint(text.encode()) == fingerprint(text)
