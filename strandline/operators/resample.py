"""Time resampling by two passes of a not-a-knot cubic spline at steps of 0.1, then the nearest of equal steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from strandline.operators.sequence import XYZ, spread


def not_a_knot(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through (0, y0), (1, y1), ... evaluated at ``at``; fewer than four points: their polynomial."""
    n = len(y)
    if n < 4:
        return np.polynomial.polynomial.polyval(at, np.polynomial.polynomial.polyfit(np.arange(n), y, n - 1)) if n > 1 else np.full(len(at), y[0])
    # second derivatives m: m[i-1] + 4 m[i] + m[i+1] = 6 d2; the third derivative is continuous at the second and last but one knot
    d2 = 6 * (y[2:] - 2 * y[1:-1] + y[:-2])
    diag, low, up, rhs = np.full(n - 2, 4.0), np.ones(n - 2), np.ones(n - 2), d2.copy()
    # m[0] = 2 m[1] - m[2], m[n-1] = 2 m[n-2] - m[n-3]
    diag[0] += 2
    up[0] -= 1
    diag[-1] += 2
    low[-1] -= 1
    for i in range(1, n - 2):
        w = low[i] / diag[i - 1]
        diag[i] -= w * up[i - 1]
        rhs[i] -= w * rhs[i - 1]
    m = np.empty(n)
    m[n - 2] = rhs[-1] / diag[-1]
    for i in range(n - 4, -1, -1):
        m[i + 1] = (rhs[i] - up[i] * m[i + 2]) / diag[i]
    m[0], m[-1] = 2 * m[1] - m[2], 2 * m[-2] - m[-3]
    k = np.clip(np.floor(at).astype(int), 0, n - 2)
    s = at - k
    return y[k] * (1 - s) + y[k + 1] * s + ((s**3 - s) * m[k + 1] + ((1 - s) ** 3 - (1 - s)) * m[k]) / 6


def resample_points(p: np.ndarray, length: int) -> np.ndarray:
    for _ in range(2):
        at = np.arange(10 * (len(p) - 1) + 1) / 10
        p = np.column_stack([not_a_knot(p[:, j], at) for j in range(p.shape[1])])
    step = len(p) / length
    # the nearest 1-based index to each step, the lower of two equally near
    return p[np.clip(np.ceil(np.arange(1, length + 1) * step - 0.5).astype(int), 1, len(p)) - 1]


def resample(df: DataFrame, length: int = 64) -> DataFrame:
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        p = resample_points(pdf.sort_values("t")[list(XYZ)].to_numpy(float), length)
        return pd.DataFrame({"seq_id": key[0], "t": np.arange(1, length + 1), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    return spread(df.select("seq_id", "t", *XYZ)).groupBy("seq_id").applyInPandas(run, "seq_id long, t long, x double, y double, z double")
