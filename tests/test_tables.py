"""Superpositions, skewed joins, files, exports and the streaming table."""

import glob

import numpy as np
import pytest
from brute import superposed, walk
from helpers import chain_table, lines_table, pair_table, transform
from pyspark.sql import functions as F

from strandfold.functions import codes, skew
from strandfold.functions import geometry as G
from strandfold.operators import chains as C
from strandfold.operators import compare as CMP
from strandfold.operators import score as SC
from strandfold.operators import select as SEL
from strandfold.operators import solutions as SOL
from strandfold.operators import superpose as S
from strandfold.sources import equivalences as EQ
from strandfold.sources import msf as M
from strandfold.sources import sinks
from strandfold.sources import structures as ST
from strandfold.streaming.best import run_best


def test_superposition_of_awkward_point_sets(spark):
    rng = np.random.default_rng(1)
    a = walk(rng, 6)
    line = np.outer(np.arange(6.0), [1, 2, 0])
    mirrored = a * [1, 1, -1]
    cases = {0: (a, a + 3), 1: (a, mirrored), 2: (line, np.outer(np.arange(6.0), [0, 1, 1])), 3: (a, walk(rng, 6)),
             4: (a * [1, 1, 0], mirrored), 5: (a, np.zeros((6, 3)))}
    rows = [(k, *map(float, p), *map(float, q)) for k, (u, v) in cases.items() for p, q in zip(u, v)]
    df = spark.createDataFrame(rows, "pair_id long, ax double, ay double, az double, bx double, by double, bz double")
    for r in S.superpose(df, ["pair_id"], transform=True).collect():
        u, v = cases[r.pair_id]
        # collinear points have a double root, known to half the digits only
        assert r.ssd == pytest.approx(superposed(u, v)[0], abs=1e-5 if r.pair_id == 2 else 1e-9)
        m = np.array(r.m).reshape(3, 4)
        assert np.linalg.det(m[:, :3]) == pytest.approx(1.0)
        assert (((v @ m[:, :3].T + m[:, 3]) - u) ** 2).sum() == pytest.approx(superposed(u, v)[0], abs=1e-9)


def test_filters_on_fitted_values_plan_quickly(spark):
    df = spark.range(10).select(F.col("id").alias("pair_id"), *[F.rand(k).alias(c) for k, c in enumerate(
        ("ax", "ay", "az", "bx", "by", "bz"))])
    assert S.superpose(df, ["pair_id"]).filter("rmsd > 0.5 and ssd < 3").count() == 0


@pytest.mark.parametrize("rows_per_split", [5, 1000])
def test_spread_join_with_a_hot_key(spark, monkeypatch, rows_per_split):
    many = spark.range(300).select("id", F.when(F.col("id") < 200, 0).otherwise(F.col("id")).alias("key"))
    one = spark.range(301).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    hot = skew.hot_keys(many.select("key"), rows_per_split)
    assert hot.count == (1 if rows_per_split == 5 else 0)
    out = skew.spread_join(many, one, "key", ["id"], hot)
    assert out.count() == 300
    assert out.filter("v <> key * 2").isEmpty()


def test_displacement_forms_agree(spark):
    rng = np.random.default_rng(2)
    points = spark.createDataFrame([(0, *map(float, p)) for p in walk(rng, 9)], "structure_id long, x double, y double, z double")
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    second = np.hstack([turn, rng.normal(size=(3, 1))]).ravel()
    t = spark.range(1).select(F.lit(0).cast("long").alias("structure_id"), F.lit(0).cast("long").alias("o_id"),
                              G.identity().alias("m1"), transform(second).alias("m2"))
    direct = CMP.direct_displacement(t, points, "structure_id").first().ssd
    closed = t.join(C.structure_moments(points), "structure_id").select(
        G.displacement_ssd(F.col("m1"), F.col("m2"), F.col("w")).alias("v")).first().v
    assert closed == pytest.approx(direct)
    # applying a composed transform equals applying both in turn
    both = points.withColumn("m", G.composed(transform(second), transform(second)))
    once = points.withColumn("m", transform(second))
    twice = S.apply_transform(S.apply_transform(once))
    assert [r.x for r in S.apply_transform(both).collect()] == pytest.approx([r.x for r in twice.collect()])


def test_probability_breaks(spark):
    df = spark.createDataFrame([(119, 900.0), (120, 900.0), (121, 1e6), (30, 0.0)], "n int, s_str double")
    rows = {r.n: r for r in SC.with_probability(df).collect()}
    ln = np.log(120)
    assert rows[119].delta_str == pytest.approx(21.351857 * np.log(119) - 37.521269)
    assert rows[121].delta_str == pytest.approx(21.351857 * ln - 37.521269)
    # the mean and its slope are continuous at the break
    assert rows[120].mu_str == pytest.approx(18.411424 * ln * ln - 4.501719 * ln + 2.637163)
    assert rows[121].p_str == pytest.approx(0.0, abs=1e-12)
    assert 0 <= rows[30].p_str <= 1


def test_pruning_keeps_different_solutions(spark):
    rows = [(0, 4, r, 10 + r, float(r), [(r // 2, 0), (9, 9)]) for r in range(1, 6)]
    df = spark.createDataFrame(rows, "pair_id long, n int, rank int, o_id long, ssd double, matches array<struct<i:int,j:int>>")
    out = SOL.prune_alternatives(df, SOL.similar_pairs(1)).orderBy("rank").collect()
    # neighbours 2,3 and 4,5 share both pairs
    assert [(r.rank, r.o_id) for r in out] == [(1, 11), (2, 12), (3, 14)]
    limited = SOL.prune_alternatives(df, SOL.similar_pairs(1), rmsd_ratio=1.5).collect()
    assert {r.o_id for r in limited} == {11, 12}


ATOM = "ATOM      1  CA  ALA A   1       1.000   2.000   3.000  1.00  0.00"


def test_structure_files(spark, tmp_path):
    (tmp_path / "one.pdb").write_text(f"REMARK a\r\n{ATOM}\r\n\nEND\n")
    (tmp_path / "two.pdb").write_text(ATOM.replace("   1.000", "   7.500") + "\n")
    lines = ST.read_structure_lines(spark, str(tmp_path / "*.pdb"))
    assert {(r.structure_id, r.line_no) for r in lines.collect()} == {("one", 1), ("one", 2), ("one", 3), ("one", 4), ("two", 1)}
    atoms = ST.parse_atoms(lines)
    assert {r.structure_id: r.x for r in atoms.collect()} == {"one": 1.0, "two": 7.5}
    assert ST.render_atoms(atoms.filter("structure_id = 'one'")).first().line == ATOM
    out = str(tmp_path / "out")
    sinks.export_lines(lines, out)
    assert spark.read.text(out).count() == 5
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "one.ent").write_text(ATOM)
    with pytest.raises(ValueError, match="equal name"):
        ST.read_structure_lines(spark, [str(tmp_path / "*.pdb"), str(tmp_path / "more")])


def test_interval_records(spark):
    long_one = "HELIX    1   1 ALA A    2  ALA A    4 " + " " * 40 + "extra"
    lines = lines_table(spark, {"s": long_one})
    row = ST.parse_sse(lines).first()
    assert (row.first_chain_id, row.first_seq_num, row.last_chain_id, row.last_seq_num) == ("A", 2, "A", 4)
    broken = lines_table(spark, {"s": "HELIX  ?"})
    assert ST.parse_sse(broken, strict=False).first().valid is False
    with pytest.raises(Exception, match="unsupported interval record"):
        ST.parse_sse(broken).collect()


def test_partly_selected_interval_is_an_error(spark):
    ids = "structure_id long, line_no int, kind string, first_chain_id string, first_seq_num int, first_insert_code string, last_chain_id string, last_seq_num int, last_insert_code string"
    sse = spark.createDataFrame([(0, 1, "HELIX", "A", 1, " ", "A", 9, " ")], ids)
    res = spark.createDataFrame([(0, k, "A", k + 1, " ", "ALA") for k in range(5)],
                                "structure_id long, pos int, chain_id string, seq_num int, insert_code string, res_name string")
    with pytest.raises(Exception, match="partly selected"):
        SEL.sse_intervals(sse, res, 4).collect()
    assert SEL.sse_intervals(sse, res, 4, strict=False).isEmpty()


def test_too_many_interval_pairs(spark):
    sse = spark.createDataFrame([(s, "HELIX", k, k + 3) for s in (0, 1) for k in range(4)],
                                "structure_id long, kind string, first_pos int, last_pos int")
    pairs = pair_table(spark, [(0, 1)])
    assert SEL.sse_interval_pairs(sse, pairs).count() == 16
    with pytest.raises(Exception, match="too many interval pairs"):
        SEL.sse_interval_pairs(sse, pairs, limit=15).collect()


def test_alignment_files(spark, tmp_path):
    (tmp_path / "t.msf").write_text("note\n//\n\nA  AB.C\nB  .XYZ\n")
    docs = M.read_docs(spark, str(tmp_path / "t.msf"))
    both = F.array(F.lit("A"), F.lit("B"))
    assert [(r.i, r.j) for r in M.msf_to_matches(M.read_aligned(docs, both)).orderBy("k").collect()] == [(1, 0), (2, 2)]
    assert M.msf_sequence(docs, F.lit("A")).first().sequence == "ABC"
    (tmp_path / "u.msf").write_text("note\n//\n\nA  ABC\nA  ABC\nB  .XYZ\n")
    with pytest.raises(Exception, match="alternate"):
        M.read_aligned(M.read_docs(spark, str(tmp_path / "u.msf")), both).collect()
    (tmp_path / "v.msf").write_text("no separator\n")
    with pytest.raises(Exception, match="no line with only"):
        M.read_aligned(M.read_docs(spark, str(tmp_path / "v.msf")), both).collect()


def test_settings_files(spark, tmp_path):
    (tmp_path / "codes").write_text("unknown ?\nGLY  G\nALA  A\n")
    (tmp_path / "atoms").write_text(" CA\n N\n\n")
    (tmp_path / "m.txt").write_text("1 0 0 5\n0 1 0 6\n0 0 1 7\n")
    table, unknown = codes.read_codes(spark, str(tmp_path / "codes"))
    assert (table, unknown) == ({"GLY": "G", "ALA": "A"}, "?")
    assert codes.read_atom_names(spark, str(tmp_path / "atoms")) == [" CA", " N"]
    assert EQ.read_transforms(spark, str(tmp_path / "m.txt")).first().m[3::4] == [5.0, 6.0, 7.0]
    df = spark.createDataFrame([("GLY",), ("XYZ",)], "r string")
    assert [r.v for r in df.select(codes.letter_of(F.col("r"), table, unknown).alias("v")).collect()] == ["G", "?"]
    assert spark.range(1).select(codes.name_of(F.lit("W")).alias("v")).first().v == "TRP"


def test_exports(spark, tmp_path):
    row = (0, 1, 2, 0.5, 0.5, [1.0, 0.0, 0.0, 1.5, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0], [(0, 1), (1, 2)])
    sol = spark.createDataFrame([row], "pair_id long, rank int, n int, ssd double, rmsd double, m array<double>, matches array<struct<i:int,j:int>>")
    seq = spark.createDataFrame([(0, "a", "bb", "GA", "VST")], "pair_id long, label_a string, label_b string, seq_a string, seq_b string")
    docs = sinks.render_solutions(sol, seq)
    got = docs.first()
    assert got.name == "align2" and "rmsd 0.5" in got.text and "1.50000" in got.text
    back = M.read_aligned(docs.select(F.lit(0).alias("doc_id"), "text"), F.array(F.lit("a"), F.lit("bb")))
    assert {r.label: r.seq for r in back.collect()} == {"a": ".GA", "bb": "VST"}
    sinks.export_solutions(docs, str(tmp_path / "docs"))
    sinks.export_transforms(sol, str(tmp_path / "m"))
    sinks.export_manifest(sol, pair_table(spark, [(3, 4)]), [" CA"], str(tmp_path / "run"))
    assert len(glob.glob(str(tmp_path / "docs/pair_id=0/rank=1/n=2/*.txt"))) == 1
    assert spark.read.json(str(tmp_path / "run")).first().atoms_used == [" CA"]


def test_streaming_table_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(int(p), int(n), k, float(v)) for k, (p, n, v) in enumerate(zip(
        rng.integers(0, 4, 60), rng.integers(2, 5, 60), rng.random(60)))]
    df = spark.createDataFrame(rows, "pair_id long, n int, o_id long, ssd double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = run_best(stream, str(tmp_path / "log"), str(tmp_path / "state"))
    key = lambda d: sorted((r.pair_id, r.n, r.ssd, r.o_id) for r in d.collect())
    assert key(table) == key(SOL.best_per_n(df))


def test_packed_points_round_trip(spark):
    rng = np.random.default_rng(9)
    chains = chain_table(spark, {4: walk(rng, 6)}, atoms=2)
    again = C.packed(C.unpacked(chains, 2))
    assert again.first().xs == chains.first().xs
    assert again.first().n == 3
