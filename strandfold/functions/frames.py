"""The one eigenvector helper that is not a plain Column expression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_AXES = T.StructType([
    T.StructField("lengths", T.ArrayType(T.DoubleType())),
    T.StructField("frame", T.ArrayType(T.DoubleType())),
])


@F.pandas_udf(_AXES)
def axes_of(scatter: pd.DataFrame) -> pd.DataFrame:
    """Eigenvalues, largest first, and unit axes (row major, one axis per row) of symmetric 3x3s."""
    v = scatter.to_numpy(dtype=float)
    full = v[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
    lengths, vectors = np.linalg.eigh(full)
    frame = vectors[:, :, ::-1].transpose(0, 2, 1).reshape(-1, 9)
    return pd.DataFrame({"lengths": list(lengths[:, ::-1]), "frame": list(frame)})
