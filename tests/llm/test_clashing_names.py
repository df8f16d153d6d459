"""Columns of the caller that have the names of working or result columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandfold.llm import mixing, near_texts, secret_scan, simhash, urls

NAMES = ["_text", "_h", "_token", "_rest", "_m_hex", "_n", "_d", "_key", "u", "q", "text_hash", "fp", "TEXT_KEY", "f_length", "b_depth", "_last"]
WORDS = "the quick brown fox jumps over the lazy dog and runs into the green wood again today".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, " ".join(WORDS[k % 5 :]) + f" token=abcdef{k:02d}", "en", "s", 5, "taken", 7) for k in range(12)]
    rows += [rows[0], (None, None, None, None, None, "x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies string, secrets int")
    return df.withColumns({n: F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in NAMES})


def untouched(rows):
    return all(r[n] == f"{n}:{'-' if r.doc_id is None else r.doc_id}" for r in rows for n in NAMES)


def test_operators_leave_other_columns_alone(docs):
    for made, added in (
        (secret_scan.secrets(docs), ["secrets"]), (secret_scan.redact(docs), []), (near_texts.one_of_each(docs), []),
        (simhash.one_of_each(docs), []), (mixing.sample(docs), ["size", "source_size", "target", "copies", "taken"]),
    ):
        assert made.columns == [c for c in docs.columns if c not in added] + added
        rows = made.collect()
        assert rows and untouched(rows)


def test_kept_columns_only(docs):
    assert secret_scan.secrets(docs, keep=["_text", "doc_id"]).columns == ["_text", "doc_id", "secrets"]
    assert mixing.sample(docs, keep=["lang"]).columns == ["lang", "size", "source_size", "target", "copies", "taken"]


def test_pages_keep_their_columns(spark):
    pages = spark.createDataFrame(
        [(k, f"https://{'bad' if k % 2 else 'good'}.com/en/{k}", "keep", "mine") for k in range(30)],
        "page_id long, url string, f_length string, host string")
    rows = urls.judge(pages).collect()
    assert {r.f_length for r in rows} == {"keep"} and {r.host for r in rows} == {"bad.com", "good.com"}


def test_stages_of_the_pipeline_return_the_columns_they_got(docs):
    for _, stage in corpus_pipeline.STAGES[:2] + corpus_pipeline.STAGES[3:]:
        made = stage(docs.sparkSession, docs, "/root/testdata/sf0.001")
        taken = ["copies"] if "copies" in made.columns[-5:] else []
        assert [c for c in made.columns if c in docs.columns and c not in taken] == [c for c in docs.columns if c not in taken]
        assert untouched(made.collect())
