"""Feature families over ordered series. Each builder adds columns; targets keep their NULLs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DEFAULT, SeriesSchema, ratio
from . import frames
from . import windows as w

#: Gamma-ray bounds of sand and shale, and the facies jump of the target.
SAND, SHALE, FACIES_JUMP = 60.0, 100.0, 1.0


def gr_flags(df: DataFrame, s: SeriesSchema = DEFAULT) -> DataFrame:
    gr = F.col(s.gr)
    return df.withColumns({"gr_shale": (gr > SHALE).cast("int"), "gr_sand": (gr < SAND).cast("int"), "gr_mudstone": gr.between(SAND, SHALE).cast("int")})


def known_flags(df: DataFrame, s: SeriesSchema = DEFAULT) -> DataFrame:
    known = F.col(s.known).isNotNull()
    return df.withColumns({"tvt_known_flag": known.cast("int"), "in_nan_zone": (~known).cast("int")})


def geometry(df: DataFrame, s: SeriesSchema = DEFAULT) -> DataFrame:
    x, y = F.col(s.x), F.col(s.y)
    df = df.withColumns({"horiz_dist": F.sqrt(x * x + y * y), "x_d1": x - F.lag(x).over(s.ordered), "y_d1": y - F.lag(y).over(s.ordered)})
    dx, dy = F.col("x_d1"), F.col("y_d1")
    return df.withColumns({"horiz_speed": F.sqrt(dx * dx + dy * dy), "horiz_dir_deg": F.degrees(F.atan2(dy, dx))})


def md_fraction(df: DataFrame, s: SeriesSchema = DEFAULT) -> DataFrame:
    """Share of the series' depth span; a span below 1 counts as 1."""
    low, high = F.min(s.md).over(s.whole), F.max(s.md).over(s.whole)
    return df.withColumn("md_frac", (F.col(s.md) - low) / F.greatest(F.lit(1.0), high - low))


def facies_flag(df: DataFrame, s: SeriesSchema = DEFAULT) -> DataFrame:
    d = F.abs(F.col(s.known) - F.lag(s.known).over(s.ordered))
    return df.withColumns({"tvt_depositional_rate": d}).withColumn("facies_change", F.when(F.col("tvt_depositional_rate") > FACIES_JUMP, 1).otherwise(0))


def median_filled(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """NULLs as the median over all rows, or over the rows of `by`."""
    if by:
        from pyspark.sql import Window

        return df.withColumns({c: F.coalesce(F.col(c), F.median(c).over(Window.partitionBy(by))) for c in columns})
    medians = df.agg(*(F.median(c).alias(f"__m_{c}") for c in columns))
    df = df.crossJoin(F.broadcast(medians))  # one row
    return df.withColumns({c: F.coalesce(F.col(c), F.col(f"__m_{c}")) for c in columns}).drop(*medians.columns)


def confidence_gate(df: DataFrame, columns: list[str], confidence: str, threshold: float = 0.70) -> DataFrame:
    """The columns where the confidence is over the threshold, else 0."""
    return df.withColumns({c: F.when(F.col(confidence) > threshold, F.col(c)).otherwise(F.lit(0.0)) for c in columns})


def with_priors(df: DataFrame, priors: dict) -> DataFrame:
    """prior_{k} constant columns for the numeric entries."""
    return df.withColumns({f"prior_{k}": F.lit(float(v)) for k, v in priors.items() if isinstance(v, (int, float)) and not isinstance(v, bool)})


def anchors(df: DataFrame, s: SeriesSchema = DEFAULT, gr: str | None = None) -> DataFrame:
    """What is known of the target, as constants of the series: the signals (gr: the gamma column) before the first unknown row,
    and each row's distance from their means over the last 20 known rows (all rows if none is known)."""
    known, gr = F.col(s.known).isNotNull(), gr or s.gr
    df = df.withColumns({"__rn": F.row_number().over(s.ordered), "__rank": F.sum(known.cast("int")).over(s.so_far), "__k": F.sum(known.cast("int")).over(s.from_here)})
    whole, far = s.whole, s.far
    df = df.withColumns({
        "anchor_tvt_mean": F.avg(s.known).over(whole), "anchor_tvt_last": F.last(s.known, True).over(far),
        "anchor_tvt_range": F.max(s.known).over(whole) - F.min(s.known).over(whole),
        "anchor_global_slope": F.coalesce(F.regr_slope(F.col(s.known), F.when(known, F.col("__rank")).cast("double")).over(whole), F.lit(0.0)),
        "anchor_length": F.sum(known.cast("int")).over(whole), "nan_length": F.sum((~known).cast("int")).over(whole),
        "__b": F.coalesce(F.min(F.when(~known, F.col("__rn"))).over(whole), F.count("*").over(whole) + 1),
    })
    near = (F.col("__b") == 1) | F.col("__rn").between(F.col("__b") - 20, F.col("__b") - 1)
    near_gr, late = F.when(near, F.col(gr)), (F.col("anchor_length") == 0) | known & (F.col("__k") <= 20)
    mean = lambda c: F.avg(F.when(late, F.col(c))).over(whole)
    df = df.withColumns({"gr_at_boundary": F.avg(near_gr).over(whole), "gr_std_at_boundary": F.coalesce(F.stddev_samp(near_gr).over(whole), F.lit(0.0)), "gr_vs_pre_nan": F.col(gr) - mean(gr), "z_vs_pre_nan": F.col(s.z) - mean(s.z)})
    length = F.col("anchor_length") + F.col("nan_length")
    return df.withColumns({"tvt_known_frac": F.col("anchor_length") / length, "nan_to_anchor_ratio": F.col("nan_length") / F.greatest(F.lit(1), F.col("anchor_length"))}).drop("__rn", "__b", "__rank", "__k")


def sequence_features(df: DataFrame, s: SeriesSchema = DEFAULT) -> DataFrame:
    """The sequence family (98 columns): gamma, position, depth, target and anchor features. Features are filled with 0."""
    before = df.columns
    raw = F.col(s.gr)
    df = w.gap_fill_linear(df, s.gr, 5, "__gr", s)
    df = df.withColumn("__gr", F.coalesce("__gr", F.median(raw).over(s.whole), F.lit(0.0)))
    df = df.withColumn("__ff", w.filled_forward(s.known, s))
    visible = lambda: [c for c in df.columns if not c.startswith("__")]
    gr_after = visible()
    df = w.lags(df, "__gr", (1, 2, 3, 5, 10, 20, -1, -2, -3, -5, -10, -20), "gr_lag", s)
    df = w.differences(df, "__gr", "gr_d", s)
    df = df.withColumns({"gr_d1_abs": F.abs("gr_d1"), "__m5": F.avg("__gr").over(s.last(5)), "gr_sand_proxy": (F.col("__gr") < SAND).cast("int"), "gr_shale_proxy": (F.col("__gr") > SHALE).cast("int")})
    df = df.withColumn("gr_grad_smooth", F.col("__m5") - F.lag("__m5").over(s.ordered))
    df = df.withColumn("__dm", F.col(s.md) - F.lag(s.md).over(s.ordered))
    df = df.withColumn("md_step", F.coalesce("__dm", F.median("__dm").over(s.whole)))
    df = w.differences(geometry(md_fraction(df, s), s), s.z, "z_d", s).withColumn("__dz", F.coalesce("z_d1", F.lit(0.0)))
    df = df.withColumns({"z_d1_abs": F.abs("z_d1"), "z_rmean_10": F.avg(s.z).over(s.last(10))} | {f"z_curve_{k}": F.stddev_samp("__dz").over(s.last(k)) for k in (5, 10, 20)})
    df = df.withColumn("z_deviation", F.col(s.z) - F.col("z_rmean_10"))
    df = df.withColumns({"tvt_ffill": F.col("__ff"), "last_known_tvt": F.last(s.known, True).over(s.far), "in_nan_zone": F.col(s.known).isNull().cast("int")})
    df = w.since_known(df, s.known, "dist_from_last_known", s)
    df = w.differences(w.gap_fill_linear(df, s.known, 3, "__t", s), "__t", "tvt_d", s)
    df = w.trailing_known(df, s.known, (5, 10, 20, 50, 100, 200), "tvt_pre_slope_", s=s)
    df = df.withColumns({f"tvt_extrap_{k}": F.col("last_known_tvt") + F.col(f"tvt_pre_slope_{k}") * F.col("dist_from_last_known") for k in (5, 10, 20, 50)})
    tvt_after = visible()
    df = anchors(w.lags(df, "tvt_ffill", (1, 2, 3, 5, 10, 20), "tvt_lag", s), s, "__gr")
    # frames come last: what goes through Python is no longer known to lie by series
    given, rolled = visible(), {"gr": ("__gr", ("mean", "std", "min", "max"), (3, 5, 10, 20, 50)), "tvt": ("__ff", ("mean", "std"), (5, 10, 20, 50))}
    of = lambda key: [F.col("__w")[f"{key}_{kind}_{k}"].alias(f"{key}_{kind}_{k}") for k in rolled[key][2] for kind in rolled[key][1]]
    ranges = [(F.col("__w")[f"gr_max_{k}"] - F.col("__w")[f"gr_min_{k}"]).alias(f"gr_range_{k}") for k in (10, 20, 50)]
    between, rest = [c for c in tvt_after if c not in gr_after], [c for c in given if c not in tvt_after]
    df = frames.rolled(df, rolled, "__w", s).select(*gr_after, *of("gr"), *ranges, *between, *of("tvt"), *rest)
    names = {f"{n}_{k}_{x}": f"{n}_r{k}_{x}" for n in ("gr", "tvt") for k in ("mean", "std", "min", "max") for x in (3, 5, 10, 20, 50)} | {f"gr_lag_lead{k}": f"gr_lead{k}" for k in (1, 2, 3, 5, 10, 20)}
    df = df.withColumnsRenamed(names)
    return df.fillna(0, subset=[c for c in df.columns if c not in before])


def stencil(n: int, width: int, degree: int, derivative: bool) -> np.ndarray:
    """Row p: the weights that give, from the values of a frame, the fitted polynomial (or its slope) at place p of it.

    The frame has the width of the result: `width`, or the greatest odd number of rows in a series of n. Where that is
    too short for the degree, the frame is the series, and the values stay (or have central differences)."""
    w = min(width, n - 1 + n % 2)
    if w <= degree or w < 3:
        return np.zeros((1, 1)) if derivative and n == 1 else np.gradient(np.eye(n), axis=0) if derivative else np.eye(n)
    t = np.arange(w)[:, None] - w // 2
    powers = np.arange(degree + 1)
    at = powers * t ** np.maximum(powers - 1, 0) if derivative else t**powers
    return at @ np.linalg.pinv(t.astype(float) ** powers)


def local_fit(frame: Column, row: Column, n: Column, width: int, degree: int, derivative: bool = False) -> Column:
    """Savitzky-Golay smoothing (or slope) of one row; NULL where its frame has a NaN.

    frame: the values of the width - 1 rows before, the row's own and those of as many rows after it (NaN for NULL); row: its
    place in its series, from 1; n: rows of the series. Rows near an end take the first or last whole frame."""
    tables = [stencil(k, width, degree, derivative) for k in range(1, width + 1)]
    kind = F.least(n, F.lit(width)).cast("int") - 1
    size = F.get(F.array(*(F.lit(len(x)) for x in tables)), kind)
    place = row - 1 - F.greatest(F.lit(0), F.least(row - 1 - F.floor(size / 2), n - size))
    begin = (F.least(row - 1, F.lit(width - 1)) - place + 1).cast("int")
    weights = F.get(F.get(F.array(*(F.array(*(F.array(*map(F.lit, map(float, r))) for r in x)) for x in tables)), kind), place.cast("int"))
    total = F.aggregate(F.zip_with(F.slice(frame, begin, size), weights, lambda v, c: v * c), F.lit(0.0), lambda t, v: t + v)
    return F.nanvl(total, F.lit(None).cast("double"))


def _frame(column: str, width: int, s: SeriesSchema) -> Column:
    return F.collect_list(F.coalesce(F.col(column).cast("double"), F.lit(float("nan")))).over(s.ordered.rowsBetween(1 - width, width - 1))


def savgol(df: DataFrame, columns: dict[str, str], width: int = 11, degree: int = 3, s: SeriesSchema = DEFAULT) -> DataFrame:
    """For each column and its new name: name, smoothed, and name_d1, its slope a row; NULLs count as the series' median."""
    df = df.withColumns({f"__f{k}": F.coalesce(F.col(c).cast("double"), F.median(c).over(s.whole), F.lit(0.0)) for k, c in enumerate(columns)})
    df = df.withColumns({f"__a{k}": _frame(f"__f{k}", width, s) for k in range(len(columns))} | {"__rn": F.row_number().over(s.ordered), "__n": F.count("*").over(s.whole)})
    made = {}
    for k, name in enumerate(columns.values()):
        made |= {f"{name}{e}": local_fit(F.col(f"__a{k}"), F.col("__rn"), F.col("__n"), width, degree, bool(e)) for e in ("", "_d1")}
    return df.withColumns(made).drop("__rn", "__n", *(f"__{x}{k}" for x in "fa" for k in range(len(columns))))


def upper_quartile(df: DataFrame, column: str, name: str, s: SeriesSchema = DEFAULT) -> DataFrame:
    """name: the 0.75 quantile of each series, between its two neighbours with as few roundings as can be: F.percentile() rounds
    three times, so that values one bit apart fall on the wrong side of it."""
    by_size = Window.partitionBy(s.well).orderBy(F.col(column).asc_nulls_last())
    df = df.withColumns({"__qr": F.row_number().over(by_size), "__qn": F.count(column).over(s.whole)})
    before = F.floor((F.col("__qn") - 1) * 3 / 4)
    df = df.withColumns({"__ql": F.max(F.when(F.col("__qr") == before + 1, F.col(column))).over(s.whole), "__qh": F.max(F.when(F.col("__qr") == F.least(before + 2, F.col("__qn")), F.col(column))).over(s.whole)})
    low, high, part = F.col("__ql"), F.col("__qh"), F.pmod((F.col("__qn") - 1) * 3, F.lit(4))  # quarters of the way
    between = F.when(part == 0, low).when(part == 1, low + (high - low) * 0.25).otherwise(low * (1 - part / 4) + high * (part / 4))
    return df.withColumn(name, between).drop("__qr", "__qn", "__ql", "__qh")


def physics_features(df: DataFrame, s: SeriesSchema = DEFAULT, smooth: bool = False) -> DataFrame:
    """The physics family (22 columns with smooth=True): rates along the path, curvature, dip and state changes.

    Depth, place and gamma are gap-filled by up to 5 rows (0 beyond), the target by up to 3; a rate that needs an unknown
    target is 0. Series of under three rows have NULLs. All windows of a family share one exchange and one sort; each
    step's windows stand in one projection."""
    given = {"__md": s.md, "__x": s.x, "__y": s.y, "__z": s.z, "__g": s.gr}
    df = w.gaps_filled(df, {n: (c, 5) for n, c in given.items() if c in df.columns} | ({"__t": (s.known, 3)} if s.known in df.columns else {}), s)
    zero, nothing = F.lit(0.0), F.lit(None).cast("double")
    df = df.withColumns({n: F.coalesce(n, zero) if c in df.columns else zero for n, c in given.items()} | ({} if s.known in df.columns else {"__t": zero}))
    df = df.withColumns({"__h": F.sqrt(F.col("__x") * F.col("__x") + F.col("__y") * F.col("__y")), "__rn": F.row_number().over(s.ordered), "__n": F.count("*").over(s.whole)})
    df = w.repaired_steps(df, "__md", "__s", s).withColumn("__s", F.when(F.col("__s") > 1e-9, F.col("__s")).otherwise(1.0))

    def rates(names: dict[str, str]) -> dict[str, Column]:
        first = F.col("__rn") == 1
        return {n: F.when(first, F.when(F.col(c).isNotNull(), zero)).otherwise((F.col(c) - F.lag(c).over(s.ordered)) / F.col("__s")) for n, c in names.items()}

    df = df.withColumns(rates({"dz_dmd": "__z", "dgr_dmd": "__g", "dx_dmd": "__x", "dy_dmd": "__y", "dtvt_dmd": "__t", "__dh": "__h"}))
    dx, dy, dz = F.col("dx_dmd"), F.col("dy_dmd"), F.col("dz_dmd")
    df = df.withColumns({"path_speed": F.sqrt(dx * dx + dy * dy + dz * dz), "__az": F.degrees(F.atan2(dy, dx)), "__ag": F.abs("dgr_dmd")})
    df = df.withColumns(rates({"d2z_dmd2": "dz_dmd", "d2gr_dmd2": "dgr_dmd", "__d2x": "dx_dmd", "__d2y": "dy_dmd", "azimuth_rate": "__az", "d2tvt_dmd2": "dtvt_dmd"}))
    df = upper_quartile(df, "__ag", "__p", s)
    smoothed = {"__t": (("dtvt_smooth", 2, True),)} | ({"__g": (("gr_savgol", 3, False), ("gr_savgol_d1", 3, True)), "__z": (("z_savgol", 3, False), ("z_savgol_d1", 3, True))} if smooth else {})
    signals = {"dgr_dmd": 0.4, "d2z_dmd2": 0.3, "dtvt_dmd": 0.3}  # fixed values: weights of the state change
    df = df.withColumns(
        {f"{c}_frame": _frame(c, 11, s) for c in smoothed} | {f"__s_{c}": F.stddev_pop(c).over(s.whole) for c in signals}
    )
    ax, ay, az, turn = F.col("__d2x"), F.col("__d2y"), F.col("d2z_dmd2"), F.col("azimuth_rate")
    cross = F.sqrt(F.pow(dy * az - dz * ay, 2) + F.pow(dz * ax - dx * az, 2) + F.pow(dx * ay - dy * ax, 2))
    along = F.when(F.abs("__dh") > 0.01, F.col("__dh")).otherwise(F.signum("__dh") * 0.01) + 1e-9
    change = sum((F.abs(c) * weight / (F.col(f"__s_{c}") + 1e-9) for c, weight in signals.items()), zero)
    df = df.withColumns({
        "azimuth_rate_abs": F.abs(turn), "curvature_3d": F.least(F.lit(1.0), F.greatest(zero, cross / (F.pow("path_speed", 3) + 1e-9))), "dogleg_proxy": F.sqrt(az * az + turn * turn), "gr_z_coupling": F.col("dgr_dmd") * dz,
        "formation_dip_proxy": F.when(F.col("dtvt_dmd").isNotNull(), F.least(F.lit(10.0), F.greatest(F.lit(-10.0), F.col("dtvt_dmd") / along))), "geo_state_change": change, "transition_signal": (F.col("__ag") > F.col("__p")).cast("int"),
        **{name: local_fit(F.col(f"{c}_frame"), F.col("__rn"), F.col("__n"), 11, degree, slope) for c, wanted in smoothed.items() for name, degree, slope in wanted},
    })
    made = [c for c in df.columns if not c.startswith("__") and c in PHYSICS]
    df = df.withColumns({c: F.when(F.col("__n") >= 3, F.coalesce(c, zero if c != "transition_signal" else F.lit(0))).otherwise(nothing if c != "transition_signal" else F.lit(None).cast("int")) for c in made})
    return df.drop(*(c for c in df.columns if c.startswith("__")))


#: Columns of physics_features(); the last four with smooth=True.
PHYSICS = (
    "dz_dmd", "dgr_dmd", "d2z_dmd2", "d2gr_dmd2", "dx_dmd", "dy_dmd", "path_speed", "azimuth_rate", "azimuth_rate_abs", "curvature_3d", "dogleg_proxy", "dtvt_dmd", "d2tvt_dmd2", "dtvt_smooth", "formation_dip_proxy",
    "gr_z_coupling", "geo_state_change", "transition_signal", "gr_savgol", "z_savgol", "gr_savgol_d1", "z_savgol_d1",
)


def baseline_features(df: DataFrame, s: SeriesSchema = DEFAULT) -> DataFrame:
    """Lags, rolling statistics and rates of five signals, target trends, proxies, unfilled, with geo_summary() of each series
    (PredictorFamily has the whole family)."""
    for c in (s.gr, s.md, s.x, s.y, s.z):
        df = w.rolling(w.lags(df, c, (1, 2, 3, 5, 10), f"{c}_lag", s), c, ("mean", "std"), (5, 10, 20), f"{c}_roll", s)
        df = df.withColumn(f"{c}_roc", F.coalesce(F.col(c) - F.lag(c).over(s.ordered), F.lit(0.0)))
    df = w.lags(df, s.known, (1, 2, 5), "tvt_lag", s)
    df = w.rolling_slope(df, s.known, 10, "tvt_trend", s).withColumn("__dz", F.abs(F.col(s.z) - F.lag(s.z).over(s.ordered)))
    df = df.withColumns({
        "tvt_delta": F.coalesce(F.col(s.known) - F.col("tvt_lag1"), F.lit(0.0)), "tvt_delta2": F.col("tvt_lag1") - F.col("tvt_lag2"), "tvt_delta5": F.col("tvt_lag1") - F.col("tvt_lag5"),
        "tvt_ffill": w.filled_forward(s.known, s), "tvt_bfill": w.filled_backward(s.known, s), "inclination_proxy": F.avg("__dz").over(s.last(5)),
        "gr_delta1": F.col(s.gr) - F.col(f"{s.gr}_lag1"), "gr_delta2": F.col(f"{s.gr}_lag1") - F.col(f"{s.gr}_lag2"), "gr_delta5": F.col(f"{s.gr}_lag1") - F.col(f"{s.gr}_lag5"),
        "gr_roll_range10": F.col(f"{s.gr}_roll_mean_10") - F.col(f"{s.gr}_roll_mean_5"), "gr_formation_stability": F.coalesce(F.stddev_samp(s.gr).over(s.last(30)), F.lit(0.0)),
        "tvt_thickness": F.max(s.known).over(s.whole) - F.min(s.known).over(s.whole),
    })
    df = w.rolling_autocorrelation(df, s.gr, 10, 20, "gr_cyclicity", s)
    df = w.event_count(df, s.gr, 20, 50, "gr_transitions", s)
    df = df.withColumn("tvt_continuity_score", F.coalesce(F.stddev_samp("tvt_delta").over(s.last(10)), F.lit(0.0)))
    return geo_summary_joined(known_flags(md_fraction(gr_flags(facies_flag(df.drop("__dz"), s), s), s), s), s)


def geo_summary(df: DataFrame, s: SeriesSchema = DEFAULT) -> DataFrame:
    """One row a series, of rows with the proxies of baseline_features."""
    proxies = ("gr_shale", "gr_sand", "gr_mudstone", "gr_cyclicity", "gr_transitions", "gr_formation_stability", "tvt_depositional_rate", "facies_change")
    out = df.groupBy(s.well).agg(
        F.avg(s.gr).alias("well_geo_gr_mean"), F.stddev_samp(s.gr).alias("well_geo_gr_std"), F.min(s.gr).alias("well_geo_gr_min"), F.max(s.gr).alias("well_geo_gr_max"),
        *(F.avg(p).alias(f"well_geo_{p}") for p in proxies), F.min_by("tvt_thickness", F.struct(*s.order)).alias("well_geo_thickness"),
    )
    diversity = F.col("well_geo_gr_shale") + F.col("well_geo_gr_sand") + F.col("well_geo_gr_mudstone")
    return out.withColumns({"well_geo_energy": F.col("well_geo_gr_formation_stability") / (F.col("well_geo_gr_mean") + 1), "well_geo_complexity": F.col("well_geo_facies_change") * F.col("well_geo_gr_transitions"), "well_geo_diversity": diversity})


def geo_summary_joined(df: DataFrame, s: SeriesSchema = DEFAULT) -> DataFrame:
    return df.join(geo_summary(df, s), s.well, "left")


def well_summary(df: DataFrame, s: SeriesSchema = DEFAULT) -> DataFrame:
    """Minimum, maximum, mean and deviation of depth, gamma, z and target of each series, spans, known share, rows."""
    made = [f(c).alias(f"well_{n}_{k}") for c, n in ((s.md, "md"), (s.gr, "gr"), (s.z, "z"), (s.known, "tvt")) for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp))]
    out = df.groupBy(s.well).agg(*made, F.avg(F.col(s.known).isNotNull().cast("double")).alias("well_known_frac"), F.count("*").alias("well_n_rows"))
    return out.withColumns({f"well_{n}_span": F.col(f"well_{n}_max") - F.col(f"well_{n}_min") for n in ("md", "gr", "z", "tvt")})


def corrected_skew(n, g1):
    """Bias-corrected skewness of n values from the population one."""
    return g1 * F.sqrt(n * (n - 1)) / (n - 2)


def corrected_kurtosis(n, g2):
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)


def well_fingerprint(df: DataFrame, s: SeriesSchema = DEFAULT) -> DataFrame:
    """The 30-column fingerprint of each series; what is undefined is 0."""
    known = F.col(s.known).isNotNull()
    df = df.withColumns({"__rn": F.row_number().over(s.ordered), "__g1": F.lag(s.gr, 1).over(s.ordered), "__g5": F.lag(s.gr, 5).over(s.ordered), "__dz": F.col(s.z) - F.lag(s.z).over(s.ordered), "__dt": F.when(known, F.col(s.known) - F.lag(s.known).over(s.ordered))})

    def corr(a: str, b: str):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        scale = F.stddev_pop(x) * F.stddev_pop(y)
        return F.when(scale > 1e-12, ratio(F.covar_pop(x, y), scale))

    n, enough = F.count(s.gr), F.count(s.known) > 5
    span = lambda c: F.max(c) - F.min(c)
    made = {
        "gr_mean": F.avg(s.gr), "gr_std": F.stddev_samp(s.gr), **{f"gr_p{p}": F.percentile(s.gr, F.lit(p / 100)) for p in (10, 25, 50, 75, 90)}, "gr_range": span(s.gr),
        "gr_skew": F.when(n > 2, corrected_skew(n, F.skewness(s.gr))), "gr_kurt": F.when(n > 3, corrected_kurtosis(n, F.kurtosis(s.gr))),
        "gr_sand_frac": F.avg((F.col(s.gr) < SAND).cast("double")), "gr_shale_frac": F.avg((F.col(s.gr) > SHALE).cast("double")),
        "gr_autocorr1": corr(s.gr, "__g1"), "gr_autocorr5": corr(s.gr, "__g5"), "gr_trend_slope": F.regr_slope(F.col(s.gr), F.col("__rn").cast("double")),
        "z_range": span(s.z), "z_std": F.stddev_samp(s.z), "z_d1_mean": F.avg("__dz"), "z_d1_std": F.stddev_samp("__dz"),
        "lateral_length_horiz": F.sqrt(F.pow(span(s.x), 2) + F.pow(span(s.y), 2)), "x_span": span(s.x), "y_span": span(s.y), "md_total": span(s.md), "md_n_rows": F.count("*"),
        "tvt_mean": F.when(enough, F.avg(s.known)), "tvt_std": F.when(enough, F.stddev_samp(s.known)), "tvt_range": F.when(enough, span(s.known)),
        "tvt_slope_mean": F.when(enough, F.avg("__dt")), "tvt_slope_std": F.when(enough, F.stddev_samp("__dt")), "tvt_known_frac": F.when(enough, F.avg(known.cast("double"))),
    }
    return df.groupBy(s.well).agg(*(F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in made.items()))


def fingerprint_windows(df: DataFrame, width: int = 100, step: int = 10, s: SeriesSchema = DEFAULT, spectral: bool = False) -> DataFrame:
    """Depositional features of the `width` rows (a multiple of `step`) from the start of each row's bucket of `step` rows on
    (computed once a bucket, joined to its rows); the last bucket, if shorter than `step`, takes the one before.

    spectral: with those of spectral_features()."""
    df = df.withColumns({"__rn": F.row_number().over(s.ordered) - 1, "__n": F.count("*").over(s.whole), "__d": F.abs(F.col(s.gr) - F.lag(s.gr).over(s.ordered))})
    bucket = F.floor(F.col("__rn") / step)
    df = df.withColumn("__b", F.when(F.col("__n") - bucket * step >= step, bucket).otherwise(F.greatest(F.lit(0), bucket - 1)).cast("int"))
    gr, there = F.col(s.gr), F.col(s.gr).isNotNull()
    # sums and changes by bucket, then of the width / step buckets of a window: no row is repeated
    x, total = F.col("__rn").cast("double"), lambda c: F.sum(F.when(there, c).otherwise(F.lit(0.0)))
    sums = {"__c": F.lit(1.0), "__x": x, "__y": gr, "__xx": x * x, "__xy": x * gr, "__yy": gr * gr, "__shale": (gr > SHALE).cast("double"), "__sand": (gr < SAND).cast("double")}
    parts = df.groupBy(s.well, bucket.cast("int").alias("__k")).agg(
        F.count("*").alias("__m"), *(total(c).alias(n) for n, c in sums.items()),
        F.collect_list("__d").alias("__all"), F.collect_list(F.when(F.col("__rn") % step > 0, F.col("__d"))).alias("__own"),  # the first change leads into the window
        *([_values(s).alias("__v")] if spectral else []),
    )
    span, rest = (Window.partitionBy(s.well).orderBy("__k").rangeBetween(k, width // step - 1) for k in (0, 1))
    at = parts.select(s.well, "__k", *(F.sum(n).over(span).alias(n) for n in ("__m", *sums)), F.sort_array(F.concat("__own", F.flatten(F.collect_list("__all").over(rest)))).alias("__ds"), *([F.flatten(F.collect_list("__v").over(span)).alias("__v")] if spectral else [])).filter(F.col("__m") >= step)
    c, mean = F.when(F.col("__c") > 0, F.col("__c")), lambda n: ratio(F.col(n), F.col("__c"))
    at = at.withColumns({
        "__slope": ratio(F.col("__xy") - F.col("__x") * F.col("__y") / c, F.when(F.col("__c") > 1, F.col("__xx") - F.col("__x") * F.col("__x") / c)),
        "depo_gr_var": F.sqrt(F.greatest(F.lit(0.0), mean("__yy") - mean("__y") * mean("__y"))), "depo_shale_fraction": mean("__shale"), "depo_sand_fraction": mean("__sand"),
    })
    place = 0.75 * (F.size("__ds") - 1)
    low, high = F.get("__ds", F.floor(place).cast("int")), F.get("__ds", F.ceil(place).cast("int"))
    at = at.withColumn("__p", low + (high - low) * (place - F.floor(place)))
    slope = F.coalesce("__slope", F.lit(0.0))
    sharp = F.coalesce(ratio(F.size(F.filter("__ds", lambda d: d > 2 * F.col("__p"))).cast("double"), F.size("__ds").cast("double")), F.lit(0.0))
    up = lambda sign: F.greatest(F.lit(0.0), sign * slope / (F.col("depo_gr_var") + 1e-9))
    at = at.withColumns({"depo_boundary_sharp": sharp, "__fine": up(1), "depo_coarsening_up": F.least(F.lit(3.0), up(-1)), "depo_fining_up": F.least(F.lit(3.0), up(1)), "depo_gr_trend": F.least(F.lit(5.0), F.greatest(F.lit(-5.0), slope))})
    at = at.withColumn("depo_channel_score", 0.4 * F.col("depo_boundary_sharp") + 0.3 * F.col("__fine") + 0.3 * F.col("depo_sand_fraction"))
    if spectral:
        at = _with_shares(at, "__v").drop("__v")
    names = [c for c in at.columns if c.startswith("depo_")]
    per_bucket = at.select(F.col(s.well).alias("__w"), "__k", *names)
    out = df.join(per_bucket, (F.col(s.well) == F.col("__w")) & (F.col("__b") == F.col("__k")), "left")
    return out.fillna(0.0, subset=names).drop("__rn", "__n", "__d", "__b", "__w", "__k")


def welch(x: np.ndarray, segment: int = 32) -> np.ndarray:
    """Power density of a series, or of each row of a matrix: Hann segments overlapping by half, each less its mean, averaged."""
    n = min(segment, x.shape[-1])
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    parts = np.lib.stride_tricks.sliding_window_view(x, n, axis=-1)[..., :: n - n // 2, :]
    power = np.mean(np.abs(np.fft.rfft((parts - parts.mean(-1, keepdims=True)) * taper)) ** 2, axis=-2) / (taper**2).sum()
    power[..., 1 : -1 if n % 2 == 0 else None] *= 2
    return power


def _values(s: SeriesSchema) -> Column:
    """The gamma of a bucket's rows (0 for NULL) in order of their place, __rn."""
    rows = F.array_sort(F.collect_list(F.struct("__rn", F.coalesce(F.col(s.gr).cast("double"), F.lit(0.0)).alias("v"))))
    return F.transform(rows, lambda r: r["v"])


def _with_shares(df: DataFrame, values: str) -> DataFrame:
    """depo_cyclicity, depo_spectral_low, depo_spectral_high of arrays (numpy: there is no transform in SQL)."""

    def shares(a: pa.Array) -> pa.Array:
        edge, v = a.offsets.to_numpy(), a.values.to_numpy(zero_copy_only=False)
        size, out = np.diff(edge), np.zeros((3, len(a)))
        for k in np.unique(size):  # few lengths: only windows at the end of a series are shorter
            mine = np.flatnonzero(size == k)
            p = welch(v[edge[mine][:, None] + np.arange(k)])
            n, total = p.shape[1], p.sum(1) + 1e-9
            out[:, mine] = p[:, n // 6 : n // 3].sum(1) / total, p[:, : n // 3].sum(1) / total, p[:, n // 3 :].sum(1) / total
        return pa.StructArray.from_arrays([pa.array(x) for x in out], ["cyclicity", "low", "high"])

    df = df.withColumn("__s", F.arrow_udf(shares, "cyclicity double, low double, high double")(values))
    return df.withColumns({f"depo_{n}": F.col("__s")[k] for n, k in (("cyclicity", "cyclicity"), ("spectral_low", "low"), ("spectral_high", "high"))}).drop("__s")


def spectral_features(df: DataFrame, width: int = 100, step: int = 10, s: SeriesSchema = DEFAULT) -> DataFrame:
    """depo_cyclicity, depo_spectral_low, depo_spectral_high of each window start; values are gathered by buckets of `step` rows."""
    df = df.withColumn("__rn", F.row_number().over(s.ordered) - 1)
    parts = df.groupBy(s.well, F.floor(F.col("__rn") / step).cast("int").alias("__k")).agg(_values(s).alias("__v"))
    ahead = Window.partitionBy(s.well).orderBy("__k").rangeBetween(0, -(-width // step) - 1)
    arrays = parts.select(s.well, (F.col("__k") * step).alias("start"), F.slice(F.flatten(F.collect_list("__v").over(ahead)), 1, width).alias("__a"))
    return _with_shares(arrays.filter(F.size("__a") >= step), "__a").drop("__a")


def target_constants(df: DataFrame, s: SeriesSchema = DEFAULT) -> DataFrame:
    """well_tvt_range, well_tvt_std: of series with more than ten known values; others: 0."""
    many = F.count(s.known).over(s.whole) > 10
    made = {"well_tvt_range": F.max(s.known).over(s.whole) - F.min(s.known).over(s.whole), "well_tvt_std": F.stddev_samp(s.known).over(s.whole)}
    return df.withColumns({n: F.when(many, c).otherwise(F.lit(0.0)) for n, c in made.items()})


def fingerprint(df: DataFrame, width: int = 100, step: int = 10, s: SeriesSchema = DEFAULT) -> DataFrame:
    """fingerprint_windows() with the spectral features, marine score and environment code (1 channel, 2 marine shale,
    3 rhythmic, 4 clean sand, 0 mixed) of each bucket."""
    df = fingerprint_windows(df, width, step, s, True).withColumn("__n", F.count("*").over(s.whole))
    there = F.col("__n") >= step
    marine = 0.5 * F.col("depo_shale_fraction") + 0.3 * (1 - F.col("depo_boundary_sharp")) + 0.2 * (1 - F.col("depo_cyclicity"))
    df = df.withColumn("depo_marine_score", F.when(there, marine).otherwise(F.lit(0.0)))
    code = F.when(F.col("depo_channel_score") > 0.5, 1.0).when(F.col("depo_marine_score") > 0.5, 2.0).when(F.col("depo_cyclicity") > 0.3, 3.0).when(F.col("depo_sand_fraction") > 0.5, 4.0).otherwise(0.0)
    df = df.withColumn("depo_environment_enc", F.when(there, code).otherwise(F.lit(0.0))).drop("__n")
    p = lambda q: F.percentile(s.gr, F.lit(q)).over(s.whole)
    df = target_constants(df, s) if s.known in df.columns else df
    return df.withColumns({"well_gr_mean": F.avg(s.gr).over(s.whole), "well_gr_std": F.stddev_pop(s.gr).over(s.whole), "well_gr_p10": p(0.1), "well_gr_p90": p(0.9), "well_gr_range": F.max(s.gr).over(s.whole) - F.min(s.gr).over(s.whole)})
