"""Per-series window operators as DataFrame builders: each adds columns and keeps the rest.

A window function can't stand inside another one, so operators of several steps add helper columns (prefix ``__``) and
drop them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT, SeriesSchema, ratio
from . import frames

#: Pairs of rows beyond which a correlation goes through frames.
MOST_PAIRS = 20
AGGREGATES = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}


def lags(df: DataFrame, column: str, steps, name: str, s: SeriesSchema = DEFAULT) -> DataFrame:
    """name{k}: the value k rows before (k < 0: after)."""
    return df.withColumns({f"{name}{k}" if k > 0 else f"{name}_lead{-k}": F.lag(column, k).over(s.ordered) if k > 0 else F.lead(column, -k).over(s.ordered) for k in steps})


def rolling(df: DataFrame, column: str, kinds, widths, name: str, s: SeriesSchema = DEFAULT) -> DataFrame:
    """name_{kind}_{width} over the last `width` rows; the deviation of one row is 0."""
    made = {}
    for w in widths:
        for k in kinds:
            c = F.max(column).over(s.last(w)) - F.min(column).over(s.last(w)) if k == "range" else AGGREGATES[k](column).over(s.last(w))
            made[f"{name}_{k}_{w}"] = F.coalesce(c, F.lit(0.0)) if k == "std" else c
    return df.withColumns(made)


def gap_fill_linear(df: DataFrame, column: str, limit: int, name: str, s: SeriesSchema = DEFAULT) -> DataFrame:
    """Linear by row position, forward, at most `limit` rows of a gap; a trailing gap repeats the last value."""
    rn, known = F.row_number().over(s.ordered), F.col(column).isNotNull()
    df = df.withColumn("__rn", rn)
    at = F.when(known, F.col("__rn"))
    df = df.withColumns({
        "__v0": F.last(column, True).over(s.so_far), "__r0": F.last(at, True).over(s.so_far),
        "__v1": F.first(column, True).over(s.from_here), "__r1": F.first(at, True).over(s.from_here),
    })
    step = F.col("__rn") - F.col("__r0")
    line = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * step / (F.col("__r1") - F.col("__r0"))
    filled = F.when(known, F.col(column)).when(step <= limit, F.when(F.col("__r1").isNull(), F.col("__v0")).otherwise(line))
    return df.withColumn(name, filled).drop("__rn", "__v0", "__r0", "__v1", "__r1")


def gaps_filled(df: DataFrame, wanted: dict[str, tuple[str, int]], s: SeriesSchema = DEFAULT) -> DataFrame:
    """gap_fill_linear() of many columns at once, new name -> (column, limit): two windows in all."""
    df = df.withColumn("__rn", F.row_number().over(s.ordered))
    ends = {}
    for k, (c, _) in enumerate(wanted.values()):
        at = F.when(F.col(c).isNotNull(), F.struct(F.col(c).cast("double").alias("v"), F.col("__rn").alias("r")))
        ends |= {f"__b{k}": F.last(at, True).over(s.so_far), f"__e{k}": F.first(at, True).over(s.from_here)}
    df, made = df.withColumns(ends), {}
    for k, (name, (c, limit)) in enumerate(wanted.items()):
        before, after = F.col(f"__b{k}"), F.col(f"__e{k}")
        step = F.col("__rn") - before["r"]
        line = F.when(after.isNull(), before["v"]).otherwise(before["v"] + (after["v"] - before["v"]) * step / (after["r"] - before["r"]))
        made[name] = F.when(F.col(c).isNotNull(), F.col(c).cast("double")).when(step <= limit, line)
    return df.withColumns(made).drop("__rn", *ends)


def filled_forward(column: str, s: SeriesSchema = DEFAULT) -> Column:
    return F.last(column, True).over(s.so_far)


def filled_backward(column: str, s: SeriesSchema = DEFAULT) -> Column:
    return F.first(column, True).over(s.from_here)


def differences(df: DataFrame, column: str, name: str, s: SeriesSchema = DEFAULT) -> DataFrame:
    """name1: first, name2: second difference."""
    df = df.withColumn(f"{name}1", F.col(column) - F.lag(column).over(s.ordered))
    return df.withColumn(f"{name}2", F.col(f"{name}1") - F.lag(f"{name}1").over(s.ordered))


def rolling_slope(df: DataFrame, column: str, width: int, name: str, s: SeriesSchema = DEFAULT) -> DataFrame:
    """Least-squares slope over the last rows by position; one row: 0; a frame with a NULL: NULL."""
    df = df.withColumn("__rn", F.row_number().over(s.ordered).cast("double"))
    w = s.last(width)
    slope = F.when(F.count("*").over(w) == 1, F.lit(0.0)).otherwise(F.regr_slope(F.col(column), F.col("__rn")).over(w))
    return df.withColumn(name, F.when(F.count(column).over(w) == F.count("*").over(w), slope)).drop("__rn")


def rolling_autocorrelation(df: DataFrame, column: str, lag: int, width: int, name: str, s: SeriesSchema = DEFAULT) -> DataFrame:
    """Correlation with the value `lag` rows before, over the pairs inside the last `width` rows; 0 if undefined."""
    if width - lag > MOST_PAIRS:
        df = df.withColumn("__a", frames.frame(column, width, s))
        return df.withColumn(name, F.coalesce(frames.correlated(F.col("__a"), lag, width), F.lit(0.0))).drop("__a")
    df = df.withColumn("__b", F.lag(column, lag).over(s.ordered))
    both = F.col(column).isNotNull() & F.col("__b").isNotNull()
    a, b, w = F.when(both, F.col(column)), F.when(both, F.col("__b")), s.last(width - lag)
    scale = F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)
    corr = F.when(scale > 1e-12, ratio(F.covar_pop(a, b).over(w), scale))
    return df.withColumn(name, F.coalesce(corr, F.lit(0.0))).drop("__b")


def event_count(df: DataFrame, column: str, jump: float, width: int, name: str, s: SeriesSchema = DEFAULT) -> DataFrame:
    """How many of the last rows changed by more than `jump`."""
    df = df.withColumn("__e", F.when(F.abs(F.col(column) - F.lag(column).over(s.ordered)) > jump, 1).otherwise(0))
    return df.withColumn(name, F.sum("__e").over(s.last(width))).drop("__e")


def since_known(df: DataFrame, column: str, name: str, s: SeriesSchema = DEFAULT) -> DataFrame:
    """Rows since the last known value (0 on known rows; leading unknown rows count from the start)."""
    df = df.withColumn("__rn", F.row_number().over(s.ordered))
    last = F.max(F.when(F.col(column).isNotNull(), F.col("__rn"))).over(s.so_far)
    return df.withColumn(name, (F.col("__rn") - F.coalesce(last, F.lit(0))).cast("int")).drop("__rn")


def trailing_known(df: DataFrame, column: str, widths, name: str, other: str | None = None, s: SeriesSchema = DEFAULT) -> DataFrame:
    """name{k}: slope of the last k known values (or mean of `other` on those rows), on unknown rows; 0 elsewhere.

    Rows are ranked among the known ones from the end, so one aggregate over the series serves instead of a wide frame."""
    known = F.col(column).isNotNull()
    df = df.withColumn("__k", F.when(known, F.sum(known.cast("int")).over(s.from_here)))
    made = {}
    for k in widths:
        near = F.col("__k") <= k
        c = F.avg(F.when(near, F.col(other))).over(s.whole) if other else F.regr_slope(F.when(near, F.col(column)), -F.col("__k").cast("double")).over(s.whole)
        made[f"{name}{k}"] = F.when(known, F.lit(0.0)).otherwise(F.coalesce(c, F.lit(0.0)))
    return df.withColumns(made).drop("__k")


def gradient(df: DataFrame, y: str, x: str, name: str, s: SeriesSchema = DEFAULT) -> DataFrame:
    """Change of y by change of x between rows; steps of x within 1e-9 count as 1; the first row is 0."""
    dx = F.col(x) - F.lag(x).over(s.ordered)
    dy = F.col(y) - F.lag(y).over(s.ordered)
    return df.withColumn(name, F.coalesce(dy / F.when(F.abs(dx) <= 1e-9, F.lit(1.0)).otherwise(dx), F.when(F.row_number().over(s.ordered) == 1, F.lit(0.0))))


def repaired_steps(df: DataFrame, x: str, name: str, s: SeriesSchema = DEFAULT) -> DataFrame:
    """Steps of x; those that aren't positive (and the first) are the median positive step."""
    df = df.withColumn("__d", F.col(x) - F.lag(x).over(s.ordered))
    usual = F.median(F.when(F.col("__d") > 0, F.col("__d"))).over(s.whole)
    return df.withColumn(name, F.when(F.col("__d") > 0, F.col("__d")).otherwise(F.coalesce(usual, F.lit(1.0)))).drop("__d")


def uniform_smooth(df: DataFrame, column: str, width: int, name: str, s: SeriesSchema = DEFAULT) -> DataFrame:
    """Centred mean of `width` rows, the series continued by its end values."""
    h = width // 2
    df = df.withColumns({"__rn": F.row_number().over(s.ordered), "__n": F.count("*").over(s.whole)})
    first, last = F.first(column).over(s.far), F.last(column).over(s.far)
    before, after = F.greatest(F.lit(0), h + 1 - F.col("__rn")), F.greatest(F.lit(0), h - (F.col("__n") - F.col("__rn")))
    total = F.sum(column).over(s.ordered.rowsBetween(-h, h)) + before * first + after * last
    return df.withColumn(name, total / width).drop("__rn", "__n")


def robust_minmax(df: DataFrame, column: str, name: str, low: float = 0.01, high: float = 0.99, s: SeriesSchema = DEFAULT) -> DataFrame:
    """Between the series' percentiles, clipped to [0, 1]; a constant series is 0."""
    a, b = (F.percentile(column, F.lit(p)).over(s.whole) for p in (low, high))
    df = df.withColumns({"__a": a, "__b": b})
    scaled = F.least(F.greatest(ratio(F.col(column) - F.col("__a"), F.col("__b") - F.col("__a")), F.lit(0.0)), F.lit(1.0))
    return df.withColumn(name, F.when(F.col("__b") - F.col("__a") < 1e-9, F.lit(0.0)).otherwise(scaled)).drop("__a", "__b")


def state_change(df: DataFrame, rates: dict[str, float], name: str, s: SeriesSchema = DEFAULT) -> DataFrame:
    """Weighted sum of absolute rates, each over its series' deviation; name_flag: over the 75th percentile."""
    df = df.withColumns({f"__s{k}": F.stddev_pop(c).over(s.whole) for k, c in enumerate(rates)})
    total = sum((w * F.abs(F.coalesce(F.col(c), F.lit(0.0))) / (F.coalesce(F.col(f"__s{k}"), F.lit(0.0)) + 1e-9) for k, (c, w) in enumerate(rates.items())), F.lit(0.0))
    df = df.withColumn(name, total).drop(*(f"__s{k}" for k in range(len(rates))))
    df = df.withColumn("__p", F.percentile(name, F.lit(0.75)).over(s.whole))
    return df.withColumn(f"{name}_flag", (F.col(name) > F.col("__p")).cast("int")).drop("__p")


def sliding_arrays(df: DataFrame, column: str, width: int, stride: int, name: str, s: SeriesSchema = DEFAULT) -> DataFrame:
    """Windows of `width` values from every `stride`-th row on, as arrays; incomplete ones and those with a NULL go."""
    df = df.withColumns({"__rn": F.row_number().over(s.ordered), name: F.collect_list(column).over(s.ordered.rowsBetween(0, width - 1))})
    return df.filter(((F.col("__rn") - 1) % stride == 0) & (F.size(name) == width)).drop("__rn")


def unit_centred(array: Column) -> Column:
    """The array less its mean, by its norm (plus 1e-8): a dot product of two of them is a Pearson correlation."""
    mean = F.aggregate(array, F.lit(0.0), lambda a, v: a + v) / F.size(array)
    centred = F.transform(array, lambda v: v - mean)
    norm = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda a, v: a + v * v)) + 1e-8
    return F.transform(centred, lambda v: v / norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
