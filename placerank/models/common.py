"""Building blocks shared by the model jobs.

* deterministic initial factors from a hash of (id, component, seed) - the same
  on any partitioning and on retry (``randn`` is neither);
* ``materialize``: reliable checkpoint into ``spark.checkpoint.dir`` to cut the
  lineage of iterative jobs (survives executor loss; never ``localCheckpoint``).
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placerank.session import discard, ensure_checkpoint_dir, tidy  # noqa: F401

# Keys whose systems are stacked and solved at once (100 factors: 80 kB a key).
SOLVE_BLOCK = 256


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a parquet table under the reliable checkpoint folder (the shared
    ``spark.checkpoint.dir`` on a cluster) and read it back: cuts the lineage of iterative
    jobs, computes the input once, and survives executor loss."""
    import uuid

    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/placerank-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.saved_at = path
    return out


def _uniform(id_col: Column, comp: int, seed: int, salt: int) -> Column:
    h = F.xxhash64(id_col, F.lit(comp), F.lit(seed), F.lit(salt))
    return (F.pmod(h, F.lit(2 ** 31)).cast("double") + 0.5) / float(2 ** 31)


def normal_vector(id_col: str, k: int, seed: int, scale: float = 0.1) -> Column:
    """``k`` pseudo-normal values with std ``scale``, a pure function of (id, component, seed)."""
    c = F.col(id_col)
    return F.array(*[
        F.sqrt(-2.0 * F.log(_uniform(c, j, seed, 1))) * F.cos(2.0 * math.pi * _uniform(c, j, seed, 2)) * scale
        for j in range(k)])


def normal_matrix(rows: int, cols: int, seed: int, scale: float = 0.1) -> np.ndarray:
    """Small driver-side matrix (feature projections), seeded."""
    return np.random.default_rng(seed).normal(0.0, scale, (rows, cols))


# matrices up to this many entries are applied as a JVM expression (no Python worker)
JVM_MATVEC_MAX_TERMS = 512


def matvec(x: Column | str, mat: np.ndarray) -> Column:
    """``x @ mat`` for a small fixed matrix: a JVM array expression when it is tiny, else an
    Arrow-batched numpy product (the matrix, features x factors, travels in the closure)."""
    m = np.asarray(mat, dtype=np.float64)
    rows, cols = m.shape
    if rows * cols <= JVM_MATVEC_MAX_TERMS:
        if isinstance(x, str):   # one SQL string: far fewer driver round trips than Column objects
            terms = [" + ".join(f"`{x}`[{r}] * CAST({float(m[r, c])!r} AS DOUBLE)" for r in range(rows))
                     for c in range(cols)]
            return F.expr("array(" + ", ".join(f"({t})" for t in terms) + ")")
        return F.array(*[sum((x[r] * F.lit(float(m[r, c])) for r in range(rows)), F.lit(0.0))
                         for c in range(cols)])
    x = F.col(x) if isinstance(x, str) else x

    @F.pandas_udf("array<double>")
    def mv(xs: pd.Series) -> pd.Series:
        if len(xs) == 0:
            return pd.Series([], dtype=object)
        X = np.stack(xs.to_numpy()).astype(np.float64)
        return pd.Series(list(X @ m))

    return mv(x)


def add_arrays(a: Column, b: Column, scale_b: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * F.lit(scale_b))


def scale_array(a: Column, s: float) -> Column:
    return F.transform(a, lambda x: x * F.lit(s))
