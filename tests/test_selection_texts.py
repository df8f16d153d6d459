"""Selection texts given as data against the same texts given one by one."""

import pytest
from pyspark.sql import functions as F

from strandfold.operators import select as SEL

SPECS = [
    "", "*", ".A", "*.B", "2-4.A", "3-*.*", "*-4", "5.A-B", "4A-8.A", "-1-3.A", "27-27B.A", "27.A", "27B.A", "2-3.B, 2-4.A",
    "1-2.A-C", "*-27.B", "3.*", "*.C-*", "27A-*.A-B", "100-150.A,*.B", "9.Q", "*.Q,2.A",
]
BAD = ["x?y", "1--", "2-3.AB", "99999999999.A"]


@pytest.fixture(scope="module")
def residues(spark):
    rows = []
    for structure in range(len(SPECS) + len(BAD)):
        numbers = [(c, n, " ") for c in "AB" for n in (1, 2, 3, 4)] + [("A", n, code) for n, code in (
            (27, " "), (27, "A"), (27, "B"), (28, " "))] + [("C", n, " ") for n in (1, 2, 3)]
        if structure % 2:
            numbers = [("A", -1, " "), ("A", 0, " "), *numbers, ("D", 5, " ")]
        rows += [(structure, pos, *r, "ALA") for pos, r in enumerate(numbers)]
    return spark.createDataFrame(
        rows, "structure_id long, pos int, chain_id string, seq_num int, insert_code string, res_name string").cache()


@pytest.fixture(scope="module")
def outcome(spark, residues):
    texts = spark.createDataFrame(
        [(k, s) for k, s in enumerate([*SPECS, *BAD])] + [(-5, "1.A")], "structure_id long, spec string")
    return SEL.selection_outcome(residues, texts).cache()


def test_same_intervals_as_one_text_at_a_time(residues, outcome):
    got = sorted(tuple(r)[:4] for r in outcome.filter("error is null").collect())
    expected = []
    for k, spec in enumerate(SPECS):
        one = SEL.selection_intervals(residues.filter(F.col("structure_id") == k), spec, strict=False)
        expected += [(r.structure_id, r.term, r.first_pos, r.last_pos) for r in one.collect()]
    assert got == sorted(expected) and len(got) > 25


def test_errors_are_rows(outcome):
    rows = {(r.structure_id, r.term, r.error) for r in outcome.filter("error is not null").collect()}
    assert {(len(SPECS) + k, 0, "term") for k in range(len(BAD))} <= rows
    assert {(SPECS.index("9.Q"), 0, "chain"), (SPECS.index("*.Q,2.A"), 0, "chain")} <= rows
    assert (SPECS.index("100-150.A,*.B"), 0, "residue") in rows
    assert not any(s == -5 for s, _, _ in rows)


def test_structures_with_an_error_select_nothing(spark, residues):
    texts = spark.createDataFrame([(0, "2-3.A"), (1, None), (2, "2.A,99.A"), (3, "x?y")], "structure_id long, spec string")
    found = SEL.select_by_text(residues, texts).groupBy("structure_id").agg(F.count(F.lit(1)), F.max("pos"))
    assert sorted(tuple(r) for r in found.collect()) == [(0, 2, 1), (1, 18, 17)]


def test_no_texts(spark, residues):
    assert SEL.selection_outcome(residues, spark.createDataFrame([], "structure_id long, spec string")).count() == 0
