"""Near copies in the pipeline's stage against plain Python."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from strandfold.llm import near_texts, paragraphs, simhash
from strandfold.llm.paragraphs import mixed


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def jaccard(x, y):
    return len(x & y) / len(x | y)


def edited(words, edits, rng):
    words = list(words)
    for k in rng.sample(range(len(words)), edits):
        words[k] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def test_stage_removes_near_copies_only(spark):
    rng = random.Random(5)
    texts = [None, "", " \n", "one two", "One  two", "one three"]
    for n in (40, 120, 400, 2000):
        for edits in (1, n // 100, n // 60, n // 45, n // 30, n // 20):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            texts += [" ".join(words), edited(words, max(1, edits), rng)]
    rows = [(k + 1, t, "en") for k, t in enumerate(texts)]
    rows += [(None, texts[7], "en"), (None, "no id, no copy", "en"), (8, texts[7], "en")]
    root = list(range(len(rows)))
    near, sets = 0, [shingles(t) for _, t, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                near += jaccard(sets[i], sets[j]) < 0.96
                root = [root[j] if r == root[i] else r for r in root]
    least = {}
    for r, (k, *_) in zip(root, rows):
        least[r] = min(least.get(r, (1, 0)), (k is None, k or 0))
    expected = sorted(k or -1 for none, k in least.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert near >= 5 and sorted(r.doc_id or -1 for r in kept.collect()) == expected


def test_links_come_from_simhash_chains(spark, monkeypatch):
    """Rings as counted bit by bit; the stage finds nothing if no chain of the rings agrees."""
    values = [np.array(v, dtype=np.uint64) for v in ([5], [7, 7, 9], range(1, 601))]
    rings = simhash.ring_bits(simhash.ring_words(values))
    for bits, v in zip(rings, values):
        each = simhash.ring_bits(simhash.ring_words([np.array([x], dtype=np.uint64) for x in set(v.tolist())]))
        assert (bits == (2 * each.sum(0) > len(each))).all() and len(bits) == simhash.RING * simhash.BITS
    rows = [(k, f"a text of ten words whose last one differs, {'x ' * 60} {' '.join(map(str, range(100)))} {k}") for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in near_texts.one_of_each(docs).collect()] == [0]
    monkeypatch.setattr(near_texts, "ring_words", lambda runs, words: np.array(
        [mixed(np.arange(words, dtype=np.uint64) + v.sum()) for v in runs]).view(np.int64))
    assert near_texts.one_of_each(docs).count() == 2


def test_texts_of_a_bucket_meet_however_its_rows_are_cut():
    rng = random.Random(2)
    marks = [rng.getrandbits(63) for _ in range(4)]
    rows = [(b, p, rng.choice(marks) ^ (1 << rng.randrange(63))) for b, n in ((1, 1), (2, 9), (3, 64), (5, 300), (6, 3), (7, 2))
            for p in range(n)]
    near = {(b, p, q) for b, p, x in rows for c, q, y in rows if b == c and p < q and (x ^ y).bit_count() <= near_texts.APART}
    kinds = [("bucket", pa.int32()), ("pid", pa.int64()), ("mark", pa.int64())]
    for size in (1, 7, 70, 1000):
        batches = [pa.RecordBatch.from_pylist([dict(zip("bucket pid mark".split(), r)) for r in rows[k : k + size]], pa.schema(kinds))
                   for k in range(0, len(rows), size)]
        got = [tuple(r.values()) for batch in near_texts.meet(iter(batches)) for r in batch.to_pylist()]
        crowded = {b for b, _, q in got if q is None}
        assert {(b, p) for b, p, q in got if q is None} == {(b, p) for b, p, _ in rows if b in crowded} and crowded == {3, 5}
        assert {r for r in got if r[2] is not None} == {
            r for r in near if r[0] not in crowded or r[2] - r[1] <= near_texts.NEXT}
    assert list(near_texts.meet(iter([])))[0].num_rows == 0


def test_crowded_buckets_lose_no_link(spark):
    rng = random.Random(9)
    heads = [[f"h{g}w{k}" for k in range(150)] for g in range(3)]
    texts = [edited(heads[k % 3], 1, rng) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in near_texts.one_of_each(docs).collect()) == [0, 1, 2]


def test_a_text_of_a_crowded_bucket_gives_one_row():
    """Each has the nearest of the texts just before it, so rows grow with the texts; other buckets give all near pairs."""
    rng = random.Random(4)
    rows = [(b, p, 7 ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63))) for b, n in ((1, 2), (2, 500), (3, 3)) for p in range(n)]
    batch = pa.RecordBatch.from_pylist(
        [dict(zip("bucket pid mark".split(), r)) for r in rows], pa.schema([("bucket", pa.int32()), ("pid", pa.int64()), ("mark", pa.int64())]))
    got = [tuple(r.values()) for made in near_texts.meet_nearest(iter([batch])) for r in made.to_pylist()]
    assert sorted(r for r in got if r[0] is None) == [(None, 0, 1), (None, 0, 1), (None, 0, 2), (None, 1, 2)]
    marks = [x for b, _, x in rows if b == 2]
    crowded = {p: q for b, p, q in got if b == 2}
    assert len(got) == 504 and set(crowded) == set(range(500)) and crowded.pop(0) is None
    for p, q in crowded.items():
        earlier = range(max(0, p - near_texts.NEXT), p)
        assert q in earlier and (marks[p] ^ marks[q]).bit_count() == min((marks[p] ^ marks[k]).bit_count() for k in earlier)
    halves = [batch.slice(k, 70) for k in range(0, len(rows), 70)]
    again = {tuple(r.values()) for made in near_texts.meet_nearest(iter(halves)) for r in made.to_pylist()}
    assert {(b, p) for b, p, _ in again if b} == {(2, p) for p in range(500)} and sum(b is None for b, *_ in again) == 3


def test_similar_texts_that_share_no_chain_are_linked(spark):
    """Pairs at 0.8 of which no chain of the rings agrees, a few in a hundred of such short texts, are near copies all the same."""
    rng = random.Random(11)
    missed = []
    while len(missed) < 4:
        words = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        pair = [" ".join(words), " ".join([*words[:36], *(f"new{rng.randrange(10**9)}" for _ in range(4))])]
        assert jaccard(*map(shingles, pair)) == 0.8
        hashes = [paragraphs.shingles(t.encode().split()) for t in pair]
        x, y = simhash.ring_bits(simhash.ring_words(hashes))
        if not (x[near_texts.BITS_OF] == y[near_texts.BITS_OF]).all(axis=1).any():
            missed.append(pair)
    below = [" ".join(f"v{k}" for k in range(40)), " ".join(f"v{k}" for k in range(4, 45))]
    assert jaccard(*map(shingles, below)) < 0.8
    texts = [t for pair in missed for t in pair] + [*below, None, "", "short", "Short "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 6, 8, 9, 10, 12]


def test_first_shingles_of_similar_texts_have_as_many_in_common_as_needed():
    rng = random.Random(6)
    for _ in range(300):
        words = [f"w{k}" for k in range(rng.randrange(1, 120))]
        other = edited(words, min(len(words), rng.randrange(1, 6)), rng) + " tail" * rng.randrange(3)
        x, y = (set(paragraphs.shingles(t.encode().split()).tolist()) for t in (" ".join(words), other))
        if jaccard(x, y) >= 0.8:
            (need, first), (_, second) = (near_texts.first_shingles(t.encode().split()) for t in (" ".join(words), other))
            assert len(set(first.tolist()) & set(second.tolist())) >= need
