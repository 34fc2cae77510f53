from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from brute import contamination, lower, near, plain_words
from brute import near as near_by_bits
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages_against_brute_force(spark, tmp_path):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    item = " ".join(word() for _ in range(30))
    rows, quality = [], []
    for i in range(300):
        good = i % 5 > 0
        text = "\n".join(" ".join(word() + ("" if good else "$$$") for _ in range(12)) + "." for _ in range(4))
        if i % 11 == 0:
            text += " " + item
        if i % 7 == 0 and rows:
            text = rows[-1][1]
            good = quality[-1]
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        quality.append(good)
    rows.append((300, None, None, None, None))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(q)) for i, q in enumerate(quality)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{n}")
        docs = spark.read.parquet(f"{tmp_path}/stage{n}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append([tuple(x) for x in docs.collect()])
    good = {i for i, q in enumerate(quality) if q}
    assert {x[0] for x in kept[0]} - {300} == good
    assert {x[0] for x in kept[1]} == {d for d, _, c in near([x[:2] for x in kept[0]]) if d == c}
    assert {x[0] for x in kept[2]} == {c[0] for c in contamination([x[:2] for x in kept[1]], [(1, item)]) if not c[-1]}
    assert {x[0] for x in kept[3]} <= {x[0] for x in kept[2]} and len(kept[3]) > 0.7 * len(kept[2])
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, text, *_ in kept[3]:
        ids = encoder.encode(text or "", add_special_tokens=False).ids + [2]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert Counter((x.doc_id, x.n_tokens, x.ids_crc32) for x in got) == want
    assert Counter((x.doc_id, x.n_tokens, x.ids_crc32) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_near_copies_of_similarity_0_8(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    passage, rows = [word() for _ in range(12)], []
    for n in (1, 4, 5, 30, 90, 300):
        for _ in range(6):
            base = [word() for _ in range(n)] + passage * (r.random() < 0.5)
            for share in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.05):
                rows.append(" ".join(word() if r.random() < share else w for w in base))
    base = [word() for _ in range(200)]
    for _ in range(120):  # a group larger than LONG, and posted by all
        near = list(base)
        for at in r.sample(range(200), r.randint(0, 5)):
            near[at] = word()
        rows.append(" ".join(near))
    r.shuffle(rows)
    rows = [*enumerate(rows), (5000, None), (5001, " \n"), (5002, ""), (None, "alone without id")]
    sets = []
    for _, text in rows:
        w = plain_words(lower(text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    want = {rows[i][0] for i in range(len(rows)) if label[i] == i}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = [x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert want < {d for d, _, c in near_by_bits(rows[:-1]) if d == c} | {None}


def plain_classes(rows):
    sets = []
    for _, text in rows:
        w = plain_words(lower(text))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return {d: rows[label[i]][0] for i, (d, _) in enumerate(rows)}


def test_variants_that_no_links_join(spark, monkeypatch):
    """A large group around one text: some members near it, many near nothing, and families of two to five among those."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    base, rows = [word() for _ in range(150)], []
    for i in range(260):
        text = list(base)
        for at in r.sample(range(150), r.choice([0, 1, 2, 4, 6, 9, 12])):
            text[at] = word()
        if i % 9 == 0:
            text = text[: r.randint(40, 150)]
        for _ in range(r.choice([1, 1, 1, 2, 5]) if i % 4 == 0 else 1):
            near = list(text)
            near[r.randrange(len(near))] = word()
            rows.append(" ".join(near))
    rows = list(enumerate(rows))
    from aminoframe.llm import shingle_dedup

    asked = []
    verified = shingle_dedup._links
    monkeypatch.setattr(shingle_dedup, "_links", lambda pairs, *more: asked.append(pairs.count()) or verified(pairs, *more))
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, hub int, rest string").repartition(5)
    got = {x.doc_id: x.component_id for x in shingle_dedup.shingle_components(docs).collect()}
    assert got == plain_classes(rows)
    assert len(asked) == 2 and sum(asked) < len(rows) ** 2 / 12


def test_pairs_to_verify_grow_with_the_members_of_a_group(spark, monkeypatch):
    """A large group of near copies of one text of 150 words, half of them near it and half near nothing."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    base, rows = [word() for _ in range(150)], []
    for _ in range(900):
        text = list(base)
        for at in r.sample(range(150), r.choice([1, 2, 3, 4, 5, 6, 8])):
            text[at] = word()
        rows.append(" ".join(text))
    rows = list(enumerate([" ".join(base), *rows]))
    from aminoframe.llm import shingle_dedup

    asked = []
    verified = shingle_dedup._links
    monkeypatch.setattr(shingle_dedup, "_links", lambda pairs, *more: asked.append(pairs.count()) or verified(pairs, *more))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: x.component_id for x in shingle_dedup.shingle_components(docs).collect()}
    assert got == plain_classes(rows)
    assert sum(asked) < 10 * len(rows)


def test_rows_of_pairs_grow_with_the_members_of_a_group(spark, monkeypatch):
    """A large group of near copies of a text that is not among them, so that any hub lacks shingles that nearly all others have."""
    r = random.Random(10)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    base, rows = [word() for _ in range(150)], []
    for _ in range(800):
        text = list(base)
        for at in r.sample(range(150), r.choice([2, 3, 4, 5, 6, 8])):
            text[at] = word()
        rows.append(" ".join(text))
    rows = list(enumerate(rows))
    from aminoframe.llm import shingle_dedup

    made = spark.sparkContext.accumulator(0)

    def counted(run):
        def go(batches):
            for batch in run(batches):
                made.add(batch.num_rows)
                yield batch

        return go

    beyond, pairs = shingle_dedup._beyond, shingle_dedup._pairs
    monkeypatch.setattr(shingle_dedup, "_beyond", lambda similarity: counted(beyond(similarity)))
    monkeypatch.setattr(shingle_dedup, "_pairs", lambda similarity, rooted: counted(pairs(similarity, True)) if rooted else pairs(similarity, False))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: x.component_id for x in shingle_dedup.shingle_components(docs).collect()}
    assert got == plain_classes(rows)
    assert 0 < made.value < 50 * len(rows), made.value


def test_near_duplicate_stage_links_by_simhash(spark):
    """Texts of one SimHash by op2's rule, with most of their five-word shingles their own."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    phrase = " ".join(word() for _ in range(9))
    often = " ".join([phrase] * 60)
    rows = [(i, f"{often} {' '.join(word() for _ in range(12))}") for i in range(4)]
    rows += [(10 + i, " ".join(word() for _ in range(40))) for i in range(5)]
    assert {d for d, _, c in near_by_bits(rows) if d == c} == {0, 10, 11, 12, 13, 14}
    assert len(set(plain_classes(rows).values())) == 9
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {0, 10, 11, 12, 13, 14}
