from pyspark.sql import functions as F

CHAIN = "structure_id long, n int, xs array<double>, ys array<double>, zs array<double>"


def chain_table(spark, coordinates, atoms=1):
    """Packed chains from {id: (n*atoms, 3) array}."""
    rows = [
        (k, len(c) // atoms, *[[float(v) for v in c[:, axis]] for axis in range(3)]) for k, c in coordinates.items()
    ]
    return spark.createDataFrame(rows, CHAIN)


def pair_table(spark, pairs):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "pair_id long, a long, b long")


def lines_table(spark, texts):
    rows = [(k, no, line) for k, text in texts.items() for no, line in enumerate(text.split("\n"), 1) if line]
    return spark.createDataFrame(rows, "structure_id string, line_no int, line string")


def match_table(spark, sets, key="pair_id"):
    rows = [(c, k, i, j) for c, ms in sets.items() for k, (i, j) in enumerate(ms)]
    return spark.createDataFrame(rows, f"{key} long, k int, i int, j int")


def transform(values):
    return F.array(*[F.lit(float(v)) for v in values])
