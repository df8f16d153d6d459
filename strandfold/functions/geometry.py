"""Rigid-body geometry as Column expressions.

A transform is an ``array<double>`` of 12 numbers, the rows of ``[R | t]``; it moves b onto a.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandfold.functions import kernels

AXES = ("x", "y", "z")
NEWTON_STEPS = 2
IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]

# Names of the sums a least-squares superposition needs.
MEANS = [f"s{side}{r}" for side in "ab" for r in AXES]
CROSSES = [f"c{r}{c}" for r in AXES for c in AXES]
MOMENTS = ["cnt", *MEANS, *CROSSES, "saa", "sbb"]


def total(terms: list[Column]) -> Column:
    return reduce(add, terms)


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    return total([(p - q) * (p - q) for p, q in zip(a, b)])


def identity() -> Column:
    return F.array(*[F.lit(v) for v in IDENTITY])


def transformed(m: Column, p: list[Column]) -> list[Column]:
    """The point ``p`` after the transform ``m``."""
    return [total([m[4 * r + c] * p[c] for c in range(3)]) + m[4 * r + 3] for r in range(3)]


def composed(outer: Column, inner: Column) -> Column:
    """The transform that applies ``inner`` first and ``outer`` second."""
    cells = []
    for r in range(3):
        for c in range(4):
            cell = total([outer[4 * r + k] * inner[4 * k + c] for k in range(3)])
            cells.append(cell + outer[4 * r + 3] if c == 3 else cell)
    return F.array(*cells)


def moment_terms(a: list[Column], b: list[Column]) -> dict[str, Column]:
    """Per point pair, what has to be summed up for a superposition."""
    out = {"cnt": F.lit(1.0)}
    out.update({f"sa{r}": a[k] for k, r in enumerate(AXES)})
    out.update({f"sb{r}": b[k] for k, r in enumerate(AXES)})
    out.update({f"c{r}{c}": a[k] * b[l] for k, r in enumerate(AXES) for l, c in enumerate(AXES)})
    out["saa"] = total([v * v for v in a])
    out["sbb"] = total([v * v for v in b])
    return out


def moment_sums(a: list[Column], b: list[Column]) -> list[Column]:
    """Aggregates for ``groupBy().agg``: one pass with map-side partial sums."""
    return [F.sum(term).alias(name) for name, term in moment_terms(a, b).items()]


def covariance() -> list[Column]:
    """Centred covariance cells, row major."""
    return [
        F.col(f"c{r}{c}") - F.col(f"sa{r}") * F.col(f"sb{c}") / F.col("cnt") for r in AXES for c in AXES
    ]


def certain(value: Column) -> Column:
    """Mark a value that is never null as such; arithmetic on it then compiles without null checks,
    which keeps the fused method small enough for the JIT compiler."""
    return F.coalesce(value, F.lit(0.0))


def with_min_ssd(df: DataFrame, out: str = "ssd") -> DataFrame:
    """Add the least sum of squared distances reachable by moving b, from the moment columns.

    Stays in generated JVM code.  The largest root of the characteristic quartic of the quaternion
    matrix is the signed sum of the singular values of the covariance.  A trigonometric estimate of
    it is polished by Newton steps, skipped where the root is (nearly) double and the slope vanishes.
    """
    keep = df.columns
    t = "_fit_"
    df = df.withColumns({f"{t}{name}": certain(F.col(name)) for name in MOMENTS})
    df = df.withColumn(f"{t}inv", certain(1 / F.col(f"{t}cnt")))
    inv = F.col(f"{t}inv")
    cov = {
        f"{t}{r}{c}": F.col(f"{t}c{r}{c}") - F.col(f"{t}sa{r}") * F.col(f"{t}sb{c}") * inv
        for r in AXES for c in AXES
    }
    squares = total([F.col(t + name) * F.col(t + name) for name in MEANS])
    spread = F.col(f"{t}saa") + F.col(f"{t}sbb") - squares * inv
    df = df.withColumns({**cov, f"{t}spread": spread})
    m = {r + c: F.col(f"{t}{r}{c}") for r in AXES for c in AXES}
    det = (
        m["xx"] * (m["yy"] * m["zz"] - m["yz"] * m["zy"])
        - m["xy"] * (m["yx"] * m["zz"] - m["yz"] * m["zx"])
        + m["xz"] * (m["yx"] * m["zy"] - m["yy"] * m["zx"])
    )
    # gram = cov' cov, symmetric
    gram = {
        f"{t}g{c}{d}": total([m[r + c] * m[r + d] for r in AXES])
        for c, d in ("xx", "yy", "zz", "xy", "xz", "yz")
    }
    df = df.withColumns({**gram, f"{t}det": det})
    g = {k[-2:]: F.col(k) for k in gram}
    trace = g["xx"] + g["yy"] + g["zz"]
    square = (
        g["xx"] * g["xx"] + g["yy"] * g["yy"] + g["zz"] * g["zz"]
        + 2 * (g["xy"] * g["xy"] + g["xz"] * g["xz"] + g["yz"] * g["yz"])
    )
    df = df.withColumns({f"{t}tr": trace, f"{t}sq": square})
    tr, sq, dt = F.col(f"{t}tr"), F.col(f"{t}sq"), F.col(f"{t}det")
    third = 1.0 / 3.0
    mean = tr * third
    df = df.withColumn(f"{t}dev", F.sqrt(F.greatest((sq - tr * mean) * (third / 2), F.lit(0.0))))
    dev = F.col(f"{t}dev")
    shifted = dt * dt - mean * (tr * tr - sq) * 0.5 + mean * mean * tr - mean * mean * mean
    ratio = F.when(dev > 0, certain(shifted / (2 * dev * dev * dev))).otherwise(F.lit(1.0))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio))) * third
    df = df.withColumn(f"{t}angle", angle)
    # With s1 the largest singular value, (s2 +- s3)^2 = tr - s1^2 + 2 det / s1 with the right sign.
    zero = F.lit(0.0)
    df = df.withColumn(f"{t}s1", F.sqrt(F.greatest(mean + 2 * dev * F.cos(F.col(f"{t}angle")), zero)))
    s1 = F.col(f"{t}s1")
    rest = F.when(s1 > 0, tr - s1 * s1 + 2 * certain(dt / s1)).otherwise(zero)
    df = df.withColumn(f"{t}r0", s1 + F.sqrt(F.greatest(rest, zero)))
    for step in range(NEWTON_STEPS):
        x = F.col(f"{t}r{step}")
        value = ((x * x - 2 * tr) * x - 8 * dt) * x + 2 * sq - tr * tr
        slope = 4 * (x * x - tr) * x - 8 * dt
        moved = F.when(F.abs(slope) > 1e-6 * x * x * x, x - certain(value / slope)).otherwise(x)
        df = df.withColumn(f"{t}r{step + 1}", moved)
    ssd = F.greatest(F.col(f"{t}spread") - 2 * F.col(f"{t}r{NEWTON_STEPS}"), F.lit(0.0))
    # The generator keeps later filters on the result above it: pushed down through the steps, a
    # condition would be spelled out in terms of the raw sums and grow exponentially.
    return df.select(*keep, F.explode(F.array(ssd)).alias(out))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _fitted_transform(fit: pd.DataFrame) -> pd.Series:
    cov = fit.iloc[:, :9].to_numpy(dtype=float).reshape(-1, 3, 3)
    mean_a = fit.iloc[:, 9:12].to_numpy(dtype=float)
    mean_b = fit.iloc[:, 12:15].to_numpy(dtype=float)
    return pd.Series(list(kernels.transforms_of(cov, mean_a, mean_b)))


def fitted_transform() -> Column:
    """The superposing transform, from the moment columns (one Arrow trip, batched eigenvectors)."""
    cells = [v.alias(f"v{k}") for k, v in enumerate(covariance())]
    cells += [(F.col(name) / F.col("cnt")).alias(f"m{k}") for k, name in enumerate(MEANS)]
    return _fitted_transform(F.struct(*cells))


def second_moments(p: list[Column]) -> dict[str, Column]:
    """Ten sums over the points of a structure that determine any displacement between transforms."""
    h = [*p, F.lit(1.0)]
    return {f"w{r}{c}": h[r] * h[c] for r in range(4) for c in range(r, 4)}


def displacement_ssd(first: Column, second: Column, w: Column) -> Column:
    """Sum over the points of |first(p) - second(p)|^2, from ``second_moments`` sums in struct ``w``."""
    out = []
    for r in range(3):
        d = [first[4 * r + c] - second[4 * r + c] for c in range(4)]
        out += [
            (1 if p == q else 2) * d[p] * d[q] * w[f"w{p}{q}"]
            for p in range(4) for q in range(p, 4)
        ]
    return F.greatest(total(out), F.lit(0.0))


def rmsd(ssd: Column, atoms: Column) -> Column:
    return F.sqrt(ssd / atoms)
