"""Statistics of wide frames: the last rows of a series as an array, whose figures numpy takes for many rows at once.

A sliding window function visits every row of a frame again for every aggregate; here the frame is gathered once, in the same
window as all others, and the rows stay where they are (no exchange). NULL (and NaN) counts as missing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT, SeriesSchema


def frame(column: str, width: int, s: SeriesSchema = DEFAULT) -> Column:
    """The values of the row and the width - 1 before it, in order, NaN for NULL."""
    return F.collect_list(F.coalesce(F.col(column).cast("double"), F.lit(float("nan")))).over(s.last(width))


def matrix(a: pa.ListArray, width: int) -> np.ndarray:
    """The arrays as rows of `width` values, the last at the right; NaN before shorter ones."""
    edge = a.offsets.to_numpy()
    at = edge[1:, None] - width + np.arange(width)
    return np.where(at >= edge[:-1, None], a.values.to_numpy(zero_copy_only=False)[np.maximum(at, 0)], np.nan) if len(a.values) else np.full((len(a), width), np.nan)


def _means(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of values, their mean, deviations from it with 0 for missing ones) of each row; equal values deviate by exactly 0."""
    there = ~np.isnan(v)
    n, top = there.sum(1), np.fmax.reduce(v, axis=1)
    low = np.where(there, v - top[:, None], 0.0)
    mean = low.sum(1) / np.maximum(n, 1)
    return n, np.where(n > 0, top + mean, np.nan), np.where(there, low - mean[:, None], 0.0)


def told(v: np.ndarray, kinds: tuple[str, ...]) -> dict[str, np.ndarray]:
    """mean, std (of samples; 0 for fewer than two values), min, max of each row."""
    n, mean, off = _means(v)
    made = {"mean": lambda: mean, "std": lambda: np.sqrt((off * off).sum(1) / np.maximum(n - 1, 1)), "min": lambda: np.fmin.reduce(v, axis=1), "max": lambda: np.fmax.reduce(v, axis=1)}
    return {k: made[k]() for k in kinds}


def rolled(df: DataFrame, wanted: dict[str, tuple[str, tuple[str, ...], tuple[int, ...]]], name: str, s: SeriesSchema = DEFAULT) -> DataFrame:
    """name: a struct of {key}_{kind}_{width} for each key -> (column, kinds, widths): what windows.rolling() gives."""
    widest: dict[str, int] = {}
    for column, _, widths in wanted.values():
        widest[column] = max(widest.get(column, 1), *widths)
    arrays = {f"__frame{i}": frame(c, k, s) for i, (c, k) in enumerate(widest.items())}
    fields = [f"{key}_{kind}_{k}" for key, (_, kinds, widths) in wanted.items() for k in widths for kind in kinds]

    def run(*frames: pa.Array) -> pa.Array:
        values = {c: matrix(a, k) for a, (c, k) in zip(frames, widest.items())}
        made = [x for c, kinds, widths in wanted.values() for k in widths for x in told(values[c][:, -k:], kinds).values()]
        return pa.StructArray.from_arrays([pa.array(x, pa.float64(), from_pandas=True) for x in made], fields)

    udf = F.arrow_udf(run, ", ".join(f"{f} double" for f in fields))
    return df.withColumns(arrays).withColumn(name, udf(*arrays)).drop(*arrays)


def correlated(values: Column, lag: int, width: int) -> Column:
    """Correlation of the values of a frame() of `width` rows with those `lag` rows before them; NULL if undefined."""

    def run(a: pa.Array) -> pa.Array:
        v = matrix(a, width)
        x, y = v[:, lag:], v[:, : width - lag]
        both = ~(np.isnan(x) | np.isnan(y))
        (n, _, x), (_, _, y) = (_means(np.where(both, c, np.nan)) for c in (x, y))
        n = np.maximum(n, 1)
        scale = np.sqrt((x * x).sum(1) / n) * np.sqrt((y * y).sum(1) / n)
        fine = scale > 1e-12
        return pa.array(np.where(fine, (x * y).sum(1) / n / np.where(fine, scale, 1.0), np.nan), pa.float64(), from_pandas=True)

    return F.arrow_udf(run, "double")(values)
