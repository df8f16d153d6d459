"""Long repeated strings where very many different segments hold the same passage, and rows that repeat."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from strandfold.llm import suffixes


def brute(rows):
    seen = Counter(t[k : k + 400] for _, t in rows for k in range(len(t) - 399))
    out = []
    for i, t in rows:
        flags = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                flags[k : k + 400] = True
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[~flags])
        out.append((i, len(t), int(flags.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def shown(df):
    rows = df.collect()
    return sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), r.kept_sha256) for r in rows), key=str)


def text_of(random_, n):
    return "".join(random_.choice("abcdefghij klmno") for _ in range(n))


@pytest.mark.parametrize("together", [256, 20, 1])
def test_a_passage_in_many_surroundings(spark, together):
    random_ = random.Random(8)
    passage, short = text_of(random_, 620), text_of(random_, 330)
    rows = []
    for k in range(400):
        own = text_of(random_, 90)
        cut = random_.randint(0, 240)
        rows.append((k, own + passage[cut : cut + random_.randint(330, 620)] + text_of(random_, random_.randint(0, 90))))
    rows += [(1000 + k, text_of(random_, 40 + k % 3) + short + text_of(random_, 60)) for k in range(60)]
    rows += [(2000, "z" * 1500), (2001, "z" * 450), (None, passage), (None, passage), (2002, passage), (2003, "")]
    rows += [(3000, text_of(random.Random(1), 700))] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert shown(suffixes.repeats(docs, together)) == brute([(i, t.encode()) for i, t in rows])


def test_more_than_a_thousand_segments_of_one_gram(spark):
    random_ = random.Random(9)
    passage = text_of(random_, 500)
    rows = [(k, text_of(random_, 130) + passage[random_.randint(0, 60) :] + text_of(random_, 20)) for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert shown(suffixes.repeats(docs)) == brute([(i, t.encode()) for i, t in rows])


def test_repeated_rows_take_linear_work(spark):
    text = text_of(random.Random(3), 5700)
    docs = spark.createDataFrame([(5, text)] * 1000 + [(None, text)] * 1000, "doc_id long, text string")
    found = suffixes.repeats(docs)
    assert {(r.n_bytes, len(r.spans), r.kept_sha256) for r in found.collect()} == {(5700, 1, hashlib.sha256(b"").hexdigest())}
