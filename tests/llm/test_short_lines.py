"""op2_paragraph_minhash on lines of few words against plain Python."""

from strandfold.llm.catalog import QUERIES

TEXTS = [
    "all rights reserved\na line of its own here", "ALL  rights reserved", "menu", "menu\nmenu\n\n  \nsearch", None, "",
    "a b c d e f g h i j k l m n o p q r s", "a b c d e f g h i j k l m n o p q r z", "a b c d e f g", "b a c d e f g",
    "w1 w2 w3 w4\nw1 w2 w3 w4 w5", "w1 w2 w3 w4 w5 w6",
]


def shingles(words):
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_short_lines_are_seen(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    places = [(d, k, line.lower().split()) for d, t in enumerate(TEXTS) for k, line in enumerate((t or "").split("\n")) if line.split()]
    root = list(range(len(places)))
    for i, (*_, x) in enumerate(places):
        for j, (*_, y) in enumerate(places[:i]):
            a, b = shingles(x), shingles(y)
            if len(a & b) >= 0.8 * len(a | b):
                root = [root[j] if r == root[i] else r for r in root]
    expected = {d: (0, 0, 0, []) for d in range(len(TEXTS))}
    for k, (d, line, words) in enumerate(places):
        same = [i for i, r in enumerate(root) if r == root[k]]
        if len(same) > 1:
            n, removed, lost, lines = expected[d]
            gone = k != min(same)
            expected[d] = (n + 1, removed + gone, lost + gone * len(words), lines + [line] * gone)
    got = {r.doc_id: (r.n_shared, r.n_removed, r.words_removed, r.removed_lines)
           for r in QUERIES["op2_paragraph_minhash"](spark, str(tmp_path)).collect()}
    assert got == expected and sum(v[1] for v in expected.values()) == 4
