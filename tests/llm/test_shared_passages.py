"""op2_paragraph_minhash on passages inside longer lines and across line ends, and on hot short lines, against plain Python."""

import random

from strandfold.llm.catalog import QUERIES

HOT = "all rights reserved by the menu"


def words(seed, count):
    chosen = random.Random(seed)
    return [f"w{chosen.randrange(10 ** 6)}" for _ in range(count)]


def around(k, inner, before=60, after=60):
    return [*words(f"before{k}", before), *inner, *words(f"after{k}", after)]


def lines(all_words, size):
    return "\n".join(" ".join(all_words[k : k + size]) for k in range(0, len(all_words), size))


def near(all_words):
    return " ".join(["changed" if k == 40 else w for k, w in enumerate(all_words)])


P, Q, R, S = words("p", 51), words("q", 70), words("r", 80), words("s", 31)
TEXTS = {
    3: " ".join(around(3, P, 200)), 7: " ".join(around(7, P, 0, 300)).upper(),  # inside lines of other lengths
    1: lines(around(1, Q), 13), 9: lines(around(9, Q, 7), 17),  # across line ends
    4: " ".join(R) + "\n" + HOT, 5: near(R) + "\n" + lines(words("own5", 90), 30),  # near copies of a long line
    11: " ".join(around(11, S)), 12: " ".join(around(12, S)), 13: HOT + "\n" + lines(words("own13", 60), 20),  # short ones
    20: "one\ntwo three", 21: "One\nTWO  three", 22: "one", 23: None, 24: "", None: " ".join(words("null", 80)),
}


def test_passages_make_classes(spark, tmp_path):
    rows = [*TEXTS.items(), (3, TEXTS[3]), (9, " ".join(around("other9", words("null", 80))))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.doc_id, r.component_id, r.n_passages > 0) for r in QUERIES["op2_paragraph_minhash"](spark, str(tmp_path)).collect()]
    assert len(got) == len(rows)
    by_id = {d: (c, n) for d, c, n in got if d not in (9, None)}
    assert by_id[3] == by_id[7] == (3, True) and by_id[1] == (1, True)
    assert by_id[4] == by_id[5] == (4, True) and by_id[20] == by_id[21] == (20, True)
    assert all(by_id[d] == (d, False) for d in (11, 12, 13, 22, 23, 24))
    # the first text of id 9 shares q with 1, its second one a passage with the null id
    assert sorted(c for d, c, _ in got if d == 9) == [1, 9] and [(c, n) for d, c, n in got if d is None] == [(9, True)]
