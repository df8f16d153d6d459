"""BPE encoding of long and odd texts in small parts against the tokenizer itself."""

import hashlib
import random

import numpy as np
import pytest

from strandfold.llm import bpe
from strandfold.llm.common import QUERIES

RANDOM = random.Random(11)
TEXTS = [
    None, "", "a", "hello world <|endoftext|> x", "a" * 2500, "ab" * 1500 + "c" * 777,
    "".join(RANDOM.choice("abcdefgh") for _ in range(4000)), "汉字，汉字。" * 400, "汉" * 900, " " * 900 + "x" + "\n" * 800,
    "it's 'tis''s don't " * 100, "<|endoftext|>" * 90, "x" * 700 + "<|endoftext|>" + "y" * 700,
    "".join(RANDOM.choice("\0 \n's A一́😀  !<\x85\x1c") for _ in range(3000)), "the quick brown fox " * 900,
    "é" * 1001, "12345" * 500, "!?" * 600 + "a'" * 500, "".join(RANDOM.choice("etaoin shrdlu,.'") for _ in range(5000)),
]


def expected(texts):
    tokenizer = bpe.load(None).tokenizer
    out = []
    for text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        digest = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        out.append((ids, len(ids), digest, hashlib.sha256(decoded.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("part,leaf", [(bpe.PART, bpe.LEAF), (300, 64), (100, 1)])
def test_parts_change_nothing(spark, part, leaf):
    texts = [*TEXTS, TEXTS[4], TEXTS[14]]
    rows = [(None if k == 5 else k, t, "clash", "keep") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string, _digest string")
    made = bpe.encode(docs, part=part, leaf=leaf).collect()
    got = sorted((str(r.doc_id), r.ids, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in made)
    assert got == sorted((str(r[0]), *e) for r, e in zip(rows, expected(texts)))
    assert {r._digest for r in made} == {"keep"}


def test_no_rows(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_settled_signs_are_split_like_the_tokenizer():
    encoder = bpe.load(None)
    texts = [p.replace("@", chr(c)) for c in range(0x180) for p in ("a@b", "@ ", " @", "1@2", "a@@b", "  @a", "'@s")]
    texts += ["".join(RANDOM.choice("ab1 '\n\tsé,.…dlvre漢А") for _ in range(RANDOM.randint(1, 14))) for _ in range(3000)]
    assert encoder(texts) == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_registered_query(spark, small):
    import duckdb

    rows = duckdb.sql(f"select doc_id, text from '{small}/documents.parquet'").fetchall()
    made = QUERIES["op13_bpe"](spark, small).collect()
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in made)
    assert got == sorted((k, *e[1:]) for (k, _), e in zip(rows, expected([t for _, t in rows])))
