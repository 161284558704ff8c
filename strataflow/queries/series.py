"""Queries over the series views: projections, windows, feature families, series summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import matching as mt
from ..operators import predictor as pf
from ..operators import relational as rel
from ..operators import windows as w
from ..plans.views import view, with_views
from ..schema import DEFAULT as S
from ..schema import SeriesSchema, aligned
from ..sources.files import kept_table
from . import query, shape, shaped

K = ["well_id", "row_seq"]
O = "OVER (PARTITION BY well_id ORDER BY row_seq)"
ALL = "OVER (PARTITION BY well_id)"
FAR = "OVER (PARTITION BY well_id ORDER BY row_seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
LONG = SeriesSchema(order=("row_seq",))


def last(k: int) -> str:
    return f"OVER (PARTITION BY well_id ORDER BY row_seq ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def oracle(select: str, ints=(), doubles=(), keys=K, views=("well_log",)) -> str:
    return with_views(shape(select, keys, ints, doubles), *views)


def log(spark, sf_dir):
    return view(spark, sf_dir, "well_log")


@query(oracle("SELECT *, CASE WHEN gr > 100 THEN 1 WHEN gr IS NOT NULL THEN 0 END AS gr_shale, CASE WHEN gr < 60 THEN 1 WHEN gr IS NOT NULL THEN 0 END AS gr_sand, CASE WHEN gr BETWEEN 60 AND 100 THEN 1 WHEN gr IS NOT NULL THEN 0 END AS gr_mudstone FROM well_log", ["gr_shale", "gr_sand", "gr_mudstone"]))
def gr_flags(spark, sf_dir):
    return shaped(ft.gr_flags(log(spark, sf_dir)), K, ["gr_shale", "gr_sand", "gr_mudstone"])


@query(oracle("SELECT *, (tvt_input IS NOT NULL)::INT AS tvt_known_flag, (tvt_input IS NULL)::INT AS in_nan_zone FROM well_log", ["tvt_known_flag", "in_nan_zone"]))
def known_flags(spark, sf_dir):
    return shaped(ft.known_flags(log(spark, sf_dir)), K, ["tvt_known_flag", "in_nan_zone"])


_G = ["horiz_dist", "horiz_speed", "horiz_dir_deg"]


@query(oracle(f"SELECT *, sqrt(x*x+y*y) AS horiz_dist, sqrt(dx*dx+dy*dy) AS horiz_speed, degrees(atan2(dy,dx)) AS horiz_dir_deg FROM (SELECT *, x - lag(x) {O} AS dx, y - lag(y) {O} AS dy FROM well_log)", [], _G))
def geometry_projection(spark, sf_dir):
    return shaped(ft.geometry(log(spark, sf_dir)), K, [], _G)


@query(oracle(f"SELECT *, (md - min(md) {ALL}) / greatest(1.0, max(md) {ALL} - min(md) {ALL}) AS md_frac FROM well_log", [], ["md_frac"]))
def md_fraction(spark, sf_dir):
    return shaped(ft.md_fraction(log(spark, sf_dir)), K, [], ["md_frac"])


@query(oracle(f"SELECT *, CASE WHEN d > 1 THEN 1 ELSE 0 END AS facies_change, d AS tvt_depositional_rate FROM (SELECT *, abs(tvt_input - lag(tvt_input) {O}) AS d FROM well_log)", ["facies_change"], ["tvt_depositional_rate"]))
def facies_flag(spark, sf_dir):
    return shaped(ft.facies_flag(log(spark, sf_dir)), K, ["facies_change"], ["tvt_depositional_rate"])


_L = [f"gr_lag{k}" for k in (1, 2, 5, 10)] + [f"gr_lag_lead{k}" for k in (1, 3)]


@query(oracle("SELECT *, " + ", ".join([f"lag(gr, {k}) {O} AS gr_lag{k}" for k in (1, 2, 5, 10)] + [f"lead(gr, {k}) {O} AS gr_lag_lead{k}" for k in (1, 3)]) + " FROM well_log", [], _L))
def lags_leads(spark, sf_dir):
    return shaped(w.lags(log(spark, sf_dir), "gr", (1, 2, 5, 10, -1, -3), "gr_lag"), K, [], _L)


def _roll(column, widths):
    parts = []
    for k in widths:
        parts += [f"avg({column}) {last(k)} AS r_mean_{k}", f"coalesce(stddev_samp({column}) {last(k)}, 0) AS r_std_{k}", f"min({column}) {last(k)} AS r_min_{k}", f"max({column}) {last(k)} AS r_max_{k}", f"sum({column}) {last(k)} AS r_sum_{k}", f"max({column}) {last(k)} - min({column}) {last(k)} AS r_range_{k}"]
    return ", ".join(parts)


_KINDS = ("mean", "std", "min", "max", "sum", "range")
_R = [f"r_{k}_{n}" for n in (3, 5, 20) for k in _KINDS]


@query(oracle(f"SELECT *, {_roll('gr', (3, 5, 20))} FROM well_log", [], _R))
def rolling_stats(spark, sf_dir):
    return shaped(w.rolling(log(spark, sf_dir), "gr", _KINDS, (3, 5, 20), "r"), K, [], _R)


_R50 = [f"r_{k}_50" for k in _KINDS]


@query(oracle(f"SELECT *, {_roll('gr', (50,))} FROM well_log_long", [], _R50, views=("well_log_long",)))
def rolling_50(spark, sf_dir):
    return shaped(w.rolling(view(spark, sf_dir, "well_log_long"), "gr", _KINDS, (50,), "r", LONG), K, [], _R50)


def _gap(column, limit, source="well_log"):
    return f"""SELECT *, CASE WHEN {column} IS NOT NULL THEN {column} WHEN row_seq - r0 <= {limit} THEN CASE WHEN r1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (row_seq - r0) / (r1 - r0) END END AS filled
    FROM (SELECT *, last_value({column} IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN {column} IS NOT NULL THEN row_seq END IGNORE NULLS) OVER b AS r0,
      first_value({column} IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN {column} IS NOT NULL THEN row_seq END IGNORE NULLS) OVER f AS r1
      FROM {source} WINDOW b AS (PARTITION BY well_id ORDER BY row_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY well_id ORDER BY row_seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(oracle(_gap("gr", 5), [], ["filled"]))
def gap_fill_linear(spark, sf_dir):
    return shaped(w.gap_fill_linear(log(spark, sf_dir), "gr", 5, "filled"), K, [], ["filled"])


@query(oracle("SELECT *, last_value(tvt_input IGNORE NULLS) OVER (PARTITION BY well_id ORDER BY row_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ff, first_value(tvt_input IGNORE NULLS) OVER (PARTITION BY well_id ORDER BY row_seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bf FROM well_log", [], ["ff", "bf"]))
def ffill_bfill(spark, sf_dir):
    return shaped(log(spark, sf_dir).withColumns({"ff": w.filled_forward("tvt_input"), "bf": w.filled_backward("tvt_input")}), K, [], ["ff", "bf"])


@query(oracle(f"SELECT *, d1 - lag(d1) {O} AS d2 FROM (SELECT *, z - lag(z) {O} AS d1 FROM well_log)", [], ["d1", "d2"]))
def diffs(spark, sf_dir):
    return shaped(w.differences(log(spark, sf_dir), "z", "d"), K, [], ["d1", "d2"])


@query(oracle(f"SELECT *, CASE WHEN count(tvt_input) {last(10)} = count(*) {last(10)} THEN CASE WHEN count(*) {last(10)} = 1 THEN 0 ELSE regr_slope(tvt_input, row_seq) {last(10)} END END AS slope FROM well_log", [], ["slope"]))
def rolling_slope(spark, sf_dir):
    return shaped(w.rolling_slope(log(spark, sf_dir), "tvt_input", 10, "slope"), K, [], ["slope"])


def _corr(a, b, over):
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    x, y = f"CASE WHEN {both} THEN {a} END", f"CASE WHEN {both} THEN {b} END"
    return f"CASE WHEN stddev_pop({x}) {over} * stddev_pop({y}) {over} > 1e-12 THEN covar_pop({x}, {y}) {over} / (stddev_pop({x}) {over} * stddev_pop({y}) {over}) END"


@query(oracle(f"SELECT *, coalesce({_corr('gr', 'b', last(10))}, 0) AS cyclicity FROM (SELECT *, lag(gr, 10) {O} AS b FROM well_log)", [], ["cyclicity"]))
def rolling_autocorr(spark, sf_dir):
    return shaped(w.rolling_autocorrelation(log(spark, sf_dir), "gr", 10, 20, "cyclicity"), K, [], ["cyclicity"])


@query(oracle(f"SELECT *, coalesce({_corr('gr', 'b', last(50))}, 0) AS cyclicity FROM (SELECT *, lag(gr, 10) {O} AS b FROM well_log_long)", [], ["cyclicity"], views=("well_log_long",)))
def long_autocorr(spark, sf_dir):
    return shaped(w.rolling_autocorrelation(view(spark, sf_dir, "well_log_long"), "gr", 10, 60, "cyclicity", LONG), K, [], ["cyclicity"])


@query(oracle(f"SELECT *, sum(e) {last(50)} AS transitions FROM (SELECT *, CASE WHEN abs(gr - lag(gr) {O}) > 20 THEN 1 ELSE 0 END AS e FROM well_log)", ["transitions"]))
def transition_count(spark, sf_dir):
    return shaped(w.event_count(log(spark, sf_dir), "gr", 20, 50, "transitions"), K, ["transitions"])


@query(oracle("SELECT *, row_seq - coalesce(max(CASE WHEN tvt_input IS NOT NULL THEN row_seq END) OVER (PARTITION BY well_id ORDER BY row_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS dist FROM well_log", ["dist"]))
def dist_from_known(spark, sf_dir):
    return shaped(w.since_known(log(spark, sf_dir), "tvt_input", "dist"), K, ["dist"])


def _trail(column, k, value, source="well_log"):
    return f"""SELECT l.*, CASE WHEN {column} IS NOT NULL THEN 0 ELSE coalesce(s.v, 0) END AS tail_value
    FROM {source} l LEFT JOIN (SELECT well_id, {value} AS v FROM (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY row_seq DESC) AS kd FROM {source} WHERE {column} IS NOT NULL) WHERE kd <= {k} GROUP BY well_id) s USING (well_id)"""


@query(oracle(_trail("tvt_input", 20, "regr_slope(tvt_input, -kd)"), [], ["tail_value"]))
def pre_null_slope(spark, sf_dir):
    return shaped(w.trailing_known(log(spark, sf_dir), "tvt_input", (20,), "s").withColumnRenamed("s20", "tail_value"), K, [], ["tail_value"])


@query(oracle(_trail("tvt_input", 20, "avg(gr)"), [], ["tail_value"]))
def pre_null_mean(spark, sf_dir):
    return shaped(w.trailing_known(log(spark, sf_dir), "tvt_input", (20,), "s", "gr").withColumnRenamed("s20", "tail_value"), K, [], ["tail_value"])


_LONGK = "(SELECT *, CASE WHEN row_seq % 3 = 0 OR row_seq > 400 THEN NULL ELSE gr END AS k FROM well_log_long)"


@query(oracle(_trail("k", 200, "regr_slope(k, -kd)", _LONGK), [], ["tail_value"], views=("well_log_long",)))
def pre_slope_200(spark, sf_dir):
    df = view(spark, sf_dir, "well_log_long").withColumn("k", F.when((F.col("row_seq") % 3 == 0) | (F.col("row_seq") > 400), None).otherwise(F.col("gr")))
    return shaped(w.trailing_known(df, "k", (200,), "s", s=LONG).withColumnRenamed("s200", "tail_value"), K, [], ["tail_value"])


@query(oracle(f"SELECT *, ff + tail_value * dist AS extrapolated FROM (SELECT *, last_value(tvt_input IGNORE NULLS) {FAR} AS ff, row_seq - coalesce(max(CASE WHEN tvt_input IS NOT NULL THEN row_seq END) OVER (PARTITION BY well_id ORDER BY row_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS dist FROM ({_trail('tvt_input', 10, 'regr_slope(tvt_input, -kd)')}))", [], ["extrapolated"]))
def extrapolation(spark, sf_dir):
    df = w.since_known(w.trailing_known(log(spark, sf_dir), "tvt_input", (10,), "s"), "tvt_input", "dist")
    df = df.withColumn("ff", F.last("tvt_input", True).over(S.far))
    return shaped(df.withColumn("extrapolated", F.col("ff") + F.col("s10") * F.col("dist")), K, [], ["extrapolated"])


@query(oracle(f"SELECT *, CASE WHEN row_seq = 1 THEN 0 ELSE (z - lag(z) {O}) / CASE WHEN abs(x - lag(x) {O}) <= 1e-9 THEN 1 ELSE x - lag(x) {O} END END AS slope, CASE WHEN x - lag(x) {O} > 0 THEN x - lag(x) {O} ELSE m END AS step FROM well_log JOIN (SELECT well_id, median(d) AS m FROM (SELECT well_id, x - lag(x) {O} AS d FROM well_log) WHERE d > 0 GROUP BY well_id) USING (well_id)", [], ["slope", "step"]))
def gradients(spark, sf_dir):
    return shaped(w.repaired_steps(w.gradient(log(spark, sf_dir), "z", "x", "slope"), "x", "step"), K, [], ["slope", "step"])


@query(oracle(f"SELECT *, (sum(z) OVER (PARTITION BY well_id ORDER BY row_seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) + greatest(0, 4 - row_seq) * first_value(z) {FAR} + greatest(0, 3 - (count(*) {ALL} - row_seq)) * last_value(z) {FAR}) / 7 AS smooth FROM well_log", [], ["smooth"]))
def uniform_smooth(spark, sf_dir):
    return shaped(w.uniform_smooth(log(spark, sf_dir), "z", 7, "smooth"), K, [], ["smooth"])


@query(oracle(f"SELECT l.*, CASE WHEN b - a < 1e-9 THEN 0 ELSE least(greatest((gr - a) / (b - a), 0), 1) END AS scaled FROM well_log l JOIN (SELECT well_id, quantile_cont(gr, 0.01) AS a, quantile_cont(gr, 0.99) AS b FROM well_log GROUP BY well_id) USING (well_id)", [], ["scaled"]))
def robust_minmax(spark, sf_dir):
    return shaped(w.robust_minmax(log(spark, sf_dir), "gr", "scaled"), K, [], ["scaled"])


@query(oracle(f"""SELECT *, (change > quantile_cont(change, 0.75) {ALL})::INT AS change_flag FROM (SELECT *, 0.6 * abs(coalesce(a, 0)) / (coalesce(stddev_pop(a) {ALL}, 0) + 1e-9) + 0.4 * abs(coalesce(b, 0)) / (coalesce(stddev_pop(b) {ALL}, 0) + 1e-9) AS change
 FROM (SELECT *, gr - lag(gr) {O} AS a, z - lag(z) {O} AS b FROM well_log))""", ["change_flag"], ["change"]))
def state_change(spark, sf_dir):
    df = log(spark, sf_dir).withColumns({"a": F.col("gr") - F.lag("gr").over(S.ordered), "b": F.col("z") - F.lag("z").over(S.ordered)})
    return shaped(w.state_change(df, {"a": 0.6, "b": 0.4}, "change"), K, ["change_flag"], ["change"])


_A = ["anchor_tvt_mean", "anchor_tvt_last", "anchor_tvt_range", "anchor_global_slope", "gr_at_boundary", "gr_std_at_boundary", "tvt_known_frac", "nan_to_anchor_ratio", "gr_vs_pre_nan", "z_vs_pre_nan"]


@query(oracle(f"""SELECT l.*, a.* EXCLUDE (well_id), al::DOUBLE / (al + nl) AS tvt_known_frac, nl::DOUBLE / greatest(1, al) AS nan_to_anchor_ratio, gr - gp AS gr_vs_pre_nan, z - zp AS z_vs_pre_nan, al AS anchor_length, nl AS nan_length
 FROM well_log l JOIN (SELECT well_id, avg(tvt_input) AS anchor_tvt_mean, arg_max(tvt_input, row_seq) FILTER (tvt_input IS NOT NULL) AS anchor_tvt_last, max(tvt_input) - min(tvt_input) AS anchor_tvt_range, coalesce(regr_slope(tvt_input, rk), 0) AS anchor_global_slope,
   count(tvt_input) AS al, count(*) - count(tvt_input) AS nl, avg(gr) FILTER (b = 1 OR row_seq BETWEEN b - 20 AND b - 1) AS gr_at_boundary, coalesce(stddev_samp(gr) FILTER (b = 1 OR row_seq BETWEEN b - 20 AND b - 1), 0) AS gr_std_at_boundary,
   avg(gr) FILTER (known = 0 OR (tvt_input IS NOT NULL AND kk <= 20)) AS gp, avg(z) FILTER (known = 0 OR (tvt_input IS NOT NULL AND kk <= 20)) AS zp
   FROM (SELECT *, count(tvt_input) OVER (PARTITION BY well_id ORDER BY row_seq) AS rk, count(tvt_input) OVER (PARTITION BY well_id ORDER BY row_seq DESC) AS kk, count(tvt_input) {ALL} AS known, coalesce(min(CASE WHEN tvt_input IS NULL THEN row_seq END) {ALL}, count(*) {ALL} + 1) AS b FROM well_log) GROUP BY well_id) a USING (well_id)""", ["anchor_length", "nan_length"], _A))
def anchor_stats(spark, sf_dir):
    return shaped(ft.anchors(log(spark, sf_dir)), K, ["anchor_length", "nan_length"], _A)


def _filled(column: str, limit: int) -> str:
    """The column gap-filled as gap_fill_linear does, from the helper columns of _GAPS."""
    return f"CASE WHEN {column} IS NOT NULL THEN {column} WHEN row_seq - {column}_r0 <= {limit} THEN CASE WHEN {column}_r1 IS NULL THEN {column}_v0 ELSE {column}_v0 + ({column}_v1 - {column}_v0) * (row_seq - {column}_r0) / ({column}_r1 - {column}_r0) END END"


_SO_FAR = "OVER (PARTITION BY well_id ORDER BY row_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_ONWARD = "OVER (PARTITION BY well_id ORDER BY row_seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_GAPS = ", ".join(f"last_value({c} IGNORE NULLS) {_SO_FAR} AS {c}_v0, max(CASE WHEN {c} IS NOT NULL THEN row_seq END) {_SO_FAR} AS {c}_r0, first_value({c} IGNORE NULLS) {_ONWARD} AS {c}_v1, min(CASE WHEN {c} IS NOT NULL THEN row_seq END) {_ONWARD} AS {c}_r1" for c in ("gr", "tvt_input"))
#: The sequence family, column by column.
_SEQUENCE = {
    **{f"gr_r{n}_{k}": f"{f}(g) {last(k)}" for k in (3, 5, 10, 20, 50) for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))},
    **{f"gr_range_{k}": f"max(g) {last(k)} - min(g) {last(k)}" for k in (10, 20, 50)},
    **{f"gr_{n}{k}": f"{f}(g, {k}) {O}" for k in (1, 2, 3, 5, 10, 20) for n, f in (("lag", "lag"), ("lead", "lead"))},
    "gr_d1": f"g - lag(g) {O}", "gr_d2": f"g - 2 * lag(g) {O} + lag(g, 2) {O}", "gr_d1_abs": f"abs(g - lag(g) {O})", "gr_grad_smooth": f"m5 - lag(m5) {O}", "gr_sand_proxy": "(g < 60)::INT", "gr_shale_proxy": "(g > 100)::INT",
    "md_step": f"coalesce(dm, median(dm) {ALL})", "md_frac": f"(md - min(md) {ALL}) / greatest(1, max(md) {ALL} - min(md) {ALL})",
    "horiz_dist": "sqrt(x * x + y * y)", "x_d1": "dx", "y_d1": "dy", "horiz_speed": "sqrt(dx * dx + dy * dy)", "horiz_dir_deg": "degrees(atan2(dy, dx))",
    "z_d1": "dz", "z_d2": f"dz - lag(dz) {O}", "z_d1_abs": "abs(dz)", "z_rmean_10": f"avg(z) {last(10)}", "z_deviation": f"z - avg(z) {last(10)}", **{f"z_curve_{k}": f"stddev_samp(coalesce(dz, 0)) {last(k)}" for k in (5, 10, 20)},
    "tvt_ffill": "tvt_input_v0", "last_known_tvt": "lk", "dist_from_last_known": "dist", "in_nan_zone": "(tvt_input IS NULL)::INT", "tvt_d1": f"t - lag(t) {O}", "tvt_d2": f"t - 2 * lag(t) {O} + lag(t, 2) {O}",
    **{f"tvt_pre_slope_{k}": f"s{k}" for k in (5, 10, 20, 50, 100, 200)}, **{f"tvt_extrap_{k}": f"lk + coalesce(s{k}, 0) * dist" for k in (5, 10, 20, 50)},
    **{f"tvt_r{n}_{k}": f"{f}(tvt_input_v0) {last(k)}" for k in (5, 10, 20, 50) for n, f in (("mean", "avg"), ("std", "stddev_samp"))}, **{f"tvt_lag{k}": f"lag(tvt_input_v0, {k}) {O}" for k in (1, 2, 3, 5, 10, 20)},
    "anchor_tvt_mean": f"avg(tvt_input) {ALL}", "anchor_tvt_last": "lk", "anchor_tvt_range": f"max(tvt_input) {ALL} - min(tvt_input) {ALL}", "anchor_global_slope": f"regr_slope(tvt_input, rk) {ALL}", "anchor_length": "al", "nan_length": "n - al",
    "tvt_known_frac": "al / n", "nan_to_anchor_ratio": "(n - al) / greatest(1, al)", "gr_at_boundary": f"avg(CASE WHEN near THEN g END) {ALL}", "gr_std_at_boundary": f"stddev_samp(CASE WHEN near THEN g END) {ALL}",
    "gr_vs_pre_nan": f"g - avg(CASE WHEN late THEN g END) {ALL}", "z_vs_pre_nan": f"z - avg(CASE WHEN late THEN z END) {ALL}",
}
_GIVEN = ["md", "x", "y", "z", "gr", "tvt", "tvt_input"]
_SEQUENCE_SQL = f"""SELECT well_id, row_seq, {", ".join(_GIVEN)}, {", ".join(f"coalesce({e}, 0) AS {n}" for n, e in _SEQUENCE.items())} FROM (
 SELECT *, avg(g) {last(5)} AS m5, {", ".join(f"CASE WHEN tvt_input IS NULL THEN regr_slope(CASE WHEN kk <= {k} THEN tvt_input END, -kk) {ALL} END AS s{k}" for k in (5, 10, 20, 50, 100, 200))},
  b = 1 OR row_seq BETWEEN b - 20 AND b - 1 AS near, al = 0 OR (tvt_input IS NOT NULL AND kk <= 20) AS late FROM (
  SELECT *, coalesce({_filled("gr", 5)}, median(gr) {ALL}, 0) AS g, {_filled("tvt_input", 3)} AS t, md - lag(md) {O} AS dm, x - lag(x) {O} AS dx, y - lag(y) {O} AS dy, z - lag(z) {O} AS dz,
   last_value(tvt_input IGNORE NULLS) {FAR} AS lk, row_seq - coalesce(tvt_input_r0, 0) AS dist, count(tvt_input) {_SO_FAR} AS rk, count(tvt_input) {_ONWARD} AS kk, count(tvt_input) {ALL} AS al, count(*) {ALL} AS n,
   coalesce(min(CASE WHEN tvt_input IS NULL THEN row_seq END) {ALL}, count(*) {ALL} + 1) AS b FROM (SELECT *, {_GAPS} FROM well_log)))"""


@query(oracle(_SEQUENCE_SQL, [], [*_GIVEN, *_SEQUENCE]))
def sequence_features(spark, sf_dir):
    return shaped(ft.sequence_features(log(spark, sf_dir)), K, [], [*_GIVEN, *_SEQUENCE])


def _rate(c: str) -> str:
    return f"CASE WHEN row_seq = 1 THEN CASE WHEN {c} IS NOT NULL THEN 0.0 END ELSE ({c} - lag({c}) {O}) / CASE WHEN step > 1e-9 THEN step ELSE 1 END END"


def _cubic(frame: str, slope: bool, degree: int = 3) -> str:
    """Least squares over the w values fr[b + 1..b + w] of an array at place u of their middle (h places from the ends), by moments."""
    y = {k: f"list_sum(list_transform(range(0, w), lambda j: {frame}[b + 1 + j] * (j - h) ** {k}))" for k in range(degree + 1)}
    t = {k: f"list_sum(list_transform(range(0, w), lambda j: ((j - h) ** {k})::DOUBLE))" for k in (0, 2, 4, 6)}
    a2 = f"({t[0]} * {y[2]} - {t[2]} * {y[0]}) / ({t[0]} * {t[4]} - {t[2]} ** 2)"
    if degree == 2:
        return f"{y[1]} / {t[2]} + 2 * u * {a2}"
    odd = f"({t[2]} * {t[6]} - {t[4]} ** 2)"
    a1, a3 = f"({t[6]} * {y[1]} - {t[4]} * {y[3]}) / {odd}", f"({t[2]} * {y[3]} - {t[4]} * {y[1]}) / {odd}"
    if slope:
        return f"CASE WHEN w > 3 THEN {a1} + 2 * u * {a2} + 3 * u * u * {a3} END"
    a0 = f"({t[4]} * {y[0]} - {t[2]} * {y[2]}) / ({t[0]} * {t[4]} - {t[2]} ** 2)"
    return f"CASE WHEN w > 3 THEN {a0} + u * {a1} + u * u * {a2} + u * u * u * {a3} END"


def _central(c: str) -> str:
    return f"(lead({c}, 1, {c}) {O} - lag({c}, 1, {c}) {O}) / CASE WHEN row_seq IN (1, n) THEN 1 ELSE 2 END"


def _smoothing(source: str) -> str:
    """Adds to rows (with n) what _cubic() needs: width w, half h, place u and where the frame begins."""
    return f"SELECT *, row_seq - 1 - s - h AS u, s - greatest(0, row_seq - 11) AS b FROM (SELECT *, greatest(0, least(row_seq - 1 - h, n - w)) AS s FROM (SELECT *, w // 2 AS h FROM (SELECT *, least(11, n - 1 + n % 2) AS w FROM {source})))"


_AROUND = "OVER (PARTITION BY well_id ORDER BY row_seq ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)"
_GAPS_ALL = ", ".join(f"last_value({c} IGNORE NULLS) {_SO_FAR} AS {c}_v0, max(CASE WHEN {c} IS NOT NULL THEN row_seq END) {_SO_FAR} AS {c}_r0, first_value({c} IGNORE NULLS) {_ONWARD} AS {c}_v1, min(CASE WHEN {c} IS NOT NULL THEN row_seq END) {_ONWARD} AS {c}_r1" for c in ("gr", "md", "x", "y", "z", "tvt_input"))
_PHYSICS = {
    **{c: c for c in ("dz_dmd", "dgr_dmd", "d2z_dmd2", "d2gr_dmd2", "dx_dmd", "dy_dmd", "path_speed", "azimuth_rate", "dtvt_dmd", "d2tvt_dmd2")}, "azimuth_rate_abs": "abs(azimuth_rate)", "dogleg_proxy": "sqrt(d2z_dmd2 ** 2 + azimuth_rate ** 2)",
    "curvature_3d": "least(1, greatest(0, sqrt((dy_dmd * d2z_dmd2 - dz_dmd * d2y) ** 2 + (dz_dmd * d2x - dx_dmd * d2z_dmd2) ** 2 + (dx_dmd * d2y - dy_dmd * d2x) ** 2) / (path_speed ** 3 + 1e-9)))", "gr_z_coupling": "dgr_dmd * dz_dmd",
    "formation_dip_proxy": "CASE WHEN dtvt_dmd IS NOT NULL THEN least(10, greatest(-10, dtvt_dmd / (CASE WHEN abs(dh) > 0.01 THEN dh ELSE sign(dh) * 0.01 END + 1e-9))) END",
    "geo_state_change": "0.4 * abs(dgr_dmd) / (sg + 1e-9) + 0.3 * abs(d2z_dmd2) / (sz + 1e-9) + 0.3 * abs(dtvt_dmd) / (st + 1e-9)", "transition_signal": "(abs(dgr_dmd) > p)::INT",
    "dtvt_smooth": f"CASE WHEN isnan({_cubic('ft', True, 2)}) THEN 0 ELSE {_cubic('ft', True, 2)} END", **{f"{c}_savgol": f"coalesce({_cubic('f' + c[0], False)}, {c[0]})" for c in ("gr", "z")}, **{f"{c}_savgol_d1": f"coalesce({_cubic('f' + c[0], True)}, {c[0]}c)" for c in ("gr", "z")},
}
_RATES = {"dz_dmd": "z", "dgr_dmd": "g", "dx_dmd": "x", "dy_dmd": "y", "dtvt_dmd": "t", "dh": "h_"}
_SECOND = {"d2z_dmd2": "dz_dmd", "d2gr_dmd2": "dgr_dmd", "d2x": "dx_dmd", "d2y": "dy_dmd", "azimuth_rate": "az", "d2tvt_dmd2": "dtvt_dmd"}
_PHYSICS_SQL = f"""WITH f AS (SELECT well_id, row_seq, count(*) {ALL} AS n, coalesce({_filled("gr", 5)}, 0) AS g, {", ".join(f"coalesce({_filled(c, 5)}, 0) AS {c}" for c in ("md", "x", "y", "z"))}, {_filled("tvt_input", 3)} AS t FROM (SELECT *, {_GAPS_ALL} FROM well_log)),
 e AS (SELECT *, sqrt(x * x + y * y) AS h_, coalesce(d, median(d) {ALL}, 1) AS step FROM (SELECT *, CASE WHEN md - lag(md) {O} > 0 THEN md - lag(md) {O} END AS d FROM f)),
 r AS (SELECT *, sqrt(dx_dmd * dx_dmd + dy_dmd * dy_dmd + dz_dmd * dz_dmd) AS path_speed, degrees(atan2(dy_dmd, dx_dmd)) AS az FROM (SELECT *, {", ".join(f"{_rate(c)} AS {n}" for n, c in _RATES.items())} FROM e)),
 q AS (SELECT *, {", ".join(f"{_rate(c)} AS {n}" for n, c in _SECOND.items())}, {_central("g")} AS gc, {_central("z")} AS zc, list(g) {_AROUND} AS fg, list(z) {_AROUND} AS fz, list(coalesce(t, 'nan'::DOUBLE)) {_AROUND} AS ft FROM r),
 m AS ({_smoothing(f"(SELECT *, stddev_pop(dgr_dmd) {ALL} AS sg, stddev_pop(d2z_dmd2) {ALL} AS sz, stddev_pop(dtvt_dmd) {ALL} AS st, quantile_cont(abs(dgr_dmd), 0.75) {ALL} AS p FROM q)")})
 SELECT well_id, row_seq, {", ".join(f"CASE WHEN n >= 3 THEN coalesce({v}, 0) END AS {k}" for k, v in _PHYSICS.items())} FROM m"""


@query(oracle(_PHYSICS_SQL, [], list(_PHYSICS)))
def physics_features(spark, sf_dir):
    return shaped(ft.physics_features(log(spark, sf_dir), smooth=True), K, [], list(_PHYSICS))


_SIGNALS = ("gr", "md", "x", "y", "z")
#: The predictor family, column by column: of each row (with helpers dz, dt, jump and the pairs g10, gr), then of each series.
_PREDICTOR = {
    **{f"{c}_lag{k}": f"lag({c}, {k}) {O}" for c in _SIGNALS for k in (1, 2, 3, 5, 10)}, **{f"{c}_roc": f"coalesce({c} - lag({c}) {O}, 0)" for c in _SIGNALS},
    **{f"{c}_roll_mean{k}": f"avg({c}) {last(k)}" for c in _SIGNALS for k in (5, 10, 20)}, **{f"{c}_roll_std{k}": f"coalesce(stddev_samp({c}) {last(k)}, 0)" for c in _SIGNALS for k in (5, 10, 20)},
    **{f"tvt_lag{k}": f"lag(tvt_input, {k}) {O}" for k in (1, 2, 5)}, "tvt_delta": "dt", "tvt_trend": f"CASE WHEN count(tvt_input) {last(10)} = count(*) {last(10)} THEN CASE WHEN count(*) {last(10)} = 1 THEN 0 ELSE regr_slope(tvt_input, row_seq) {last(10)} END END",
    "horiz_dist": "sqrt(x * x + y * y)", "inclination_proxy": f"avg(dz) {last(5)}", "md_frac": f"(md - min(md) {ALL}) / coalesce(nullif(max(md) {ALL} - min(md) {ALL}, 0), 1)",
    "tvt_ffill": f"coalesce(last_value(tvt_input IGNORE NULLS) {_SO_FAR}, 0)", "tvt_bfill": f"coalesce(first_value(tvt_input IGNORE NULLS) {_ONWARD}, 0)", "tvt_known_flag": "(tvt_input IS NOT NULL)::INT",
    "tvt_delta2": f"lag(tvt_input) {O} - lag(tvt_input, 2) {O}", "tvt_delta5": f"lag(tvt_input) {O} - lag(tvt_input, 5) {O}", "gr_delta1": f"gr - lag(gr) {O}", "gr_delta2": f"lag(gr) {O} - lag(gr, 2) {O}", "gr_delta5": f"lag(gr) {O} - lag(gr, 5) {O}",
    "gr_roll_range10": f"avg(gr) {last(10)} - avg(gr) {last(5)}", "gr_shale_proxy": "coalesce((gr > 100)::INT, 0)", "gr_sand_proxy": "coalesce((gr < 60)::INT, 0)", "gr_mudstone_proxy": "coalesce((gr BETWEEN 60 AND 100)::INT, 0)",
    "gr_autocorr_lag10": f"coalesce(CASE WHEN count(a) {last(10)} = count(CASE WHEN row_seq > 10 THEN 1 END) {last(10)} AND stddev_pop(a) {last(10)} * stddev_pop(b) {last(10)} > 1e-12 THEN covar_pop(a, b) {last(10)} / (stddev_pop(a) {last(10)} * stddev_pop(b) {last(10)}) END, 0)",
    "gr_transition_count": f"sum(jump) {last(50)}", "gr_formation_stability": f"coalesce(stddev_samp(gr) {last(30)}, 0)", "tvt_depositional_rate": "abs(dt)", "tvt_formation_thickness": f"max(tvt_input) {ALL} - min(tvt_input) {ALL}",
    "tvt_facies_change": "(abs(dt) > 1)::INT", "tvt_continuity_score": f"coalesce(stddev_samp(dt) {last(10)}, 0)",
}
_GEO = {
    **{f"well_geo_gr_{n}": f"coalesce({f}(gr) {ALL}, 0)" for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))}, **{f"well_geo_{p}": f"avg({p}) {ALL}" for p in pf.PROXIES}, "well_geo_tvt_formation_thickness": "coalesce(tvt_formation_thickness, 0)",
    "well_geo_depositional_energy": f"avg(gr_formation_stability) {ALL} / (coalesce(avg(gr) {ALL}, 0) + 1)", "well_geo_facies_complexity": f"avg(tvt_facies_change) {ALL} * avg(gr_transition_count) {ALL}",
    "well_geo_lithology_diversity": f"avg(gr_shale_proxy + gr_sand_proxy + gr_mudstone_proxy) {ALL}",
}
_FAMILY = [*_SIGNALS, *_PREDICTOR, *_GEO]
_FAMILY_SQL = f"""WITH f AS (SELECT well_id, row_seq, {", ".join(_SIGNALS)}, {", ".join(f"{e} AS {n}" for n, e in _PREDICTOR.items())} FROM (
  SELECT *, abs(z - lag(z) {O}) AS dz, coalesce(tvt_input - lag(tvt_input) {O}, 0) AS dt, coalesce((abs(gr - lag(gr) {O}) > 20)::INT, 0) AS jump, CASE WHEN gr IS NOT NULL THEN lag(gr, 10) {O} END AS a, CASE WHEN lag(gr, 10) {O} IS NOT NULL THEN gr END AS b FROM well_log)),
 g AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e in _GEO.items())} FROM f), m AS (SELECT {", ".join(f"median({c}) AS {c}" for c in _FAMILY)} FROM g)
 SELECT well_id, row_seq, {", ".join(f"coalesce(g.{c}, m.{c}) AS {c}" for c in _FAMILY)} FROM g, m"""


@query(oracle("SELECT * FROM (" + _FAMILY_SQL + ")", [], _FAMILY))
def baseline_features(spark, sf_dir):
    """The predictor family without matches and clusters, medians exact."""
    df = log(spark, sf_dir)
    return shaped(pf.PredictorFamily(exact=True).fit(df).transform(df), K, [], _FAMILY)


@query()
def predictor_family(spark, sf_dir):
    """The whole family: gated matches of the reference series, clusters of series, approximate medians."""
    df = log(spark, sf_dir)
    found = mt.window_matches(df, rel.typewell(df))
    sampled = found.select("well_id", "i", F.struct(*pf.MATCHES).alias("m"))
    matches = kept_table(rel.nearest_fill(df, sampled, 10, "m").select("well_id", "md", "row_seq", "m.*"), "matches")  # fit and transform read it
    out = pf.PredictorFamily(3).fit(df, matches).transform(df, matches)
    return shaped(out, K, ["well_cluster_id"], [*_FAMILY, *pf.MATCHES, "tw_best_tvt_gated", "tw_weighted_tvt_gated", "tw_spread_penalty"])


@query(oracle(f"""SELECT well_id, row_seq, coalesce({_cubic("fz", False)}, z) AS z_savgol, coalesce({_cubic("fz", True)}, CASE WHEN n > 1 THEN zc ELSE 0 END) AS z_savgol_d1
 FROM ({_smoothing(f"(SELECT *, {_central('z')} AS zc, list(z) {_AROUND} AS fz FROM (SELECT *, count(*) {ALL} AS n FROM well_log))")})""", [], ["z_savgol", "z_savgol_d1"]))
def savgol(spark, sf_dir):
    return shaped(ft.savgol(log(spark, sf_dir), {"z": "z_savgol"}), K, [], ["z_savgol", "z_savgol_d1"])


@query()
def welch(spark, sf_dir):
    return shaped(ft.spectral_features(log(spark, sf_dir)), ["well_id"], ["start"], ["depo_cyclicity", "depo_spectral_low", "depo_spectral_high"])


_FW = ["depo_gr_var", "depo_shale_fraction", "depo_sand_fraction", "depo_boundary_sharp", "depo_coarsening_up", "depo_fining_up", "depo_gr_trend", "depo_channel_score"]
_AHEAD = "OVER (PARTITION BY well_id ORDER BY row_seq ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING)"


@query(oracle(f"""SELECT r.well_id, r.row_seq, t.* EXCLUDE (well_id, k) FROM (SELECT *, CASE WHEN n - ((row_seq - 1) // 10) * 10 >= 10 THEN (row_seq - 1) // 10 ELSE greatest(0, (row_seq - 1) // 10 - 1) END AS b FROM (SELECT *, count(*) {ALL} AS n FROM well_log_long)) r
 LEFT JOIN (SELECT well_id, k, v AS depo_gr_var, shale AS depo_shale_fraction, sand AS depo_sand_fraction, sharp AS depo_boundary_sharp, least(3, greatest(0, -slope / (v + 1e-9))) AS depo_coarsening_up, least(3, greatest(0, slope / (v + 1e-9))) AS depo_fining_up, least(5, greatest(-5, slope)) AS depo_gr_trend, 0.4 * sharp + 0.3 * greatest(0, slope / (v + 1e-9)) + 0.3 * sand AS depo_channel_score
   FROM (SELECT well_id, (row_seq - 1) // 10 AS k, v, shale, sand, slope, len(list_filter(ds, lambda q: q > 2 * p)) / len(ds) AS sharp
     FROM (SELECT *, stddev_pop(gr) {_AHEAD} AS v, avg((gr > 100)::INT) {_AHEAD} AS shale, avg((gr < 60)::INT) {_AHEAD} AS sand, regr_slope(gr, row_seq) {_AHEAD} AS slope, count(*) {_AHEAD} AS m, list(d) OVER inside AS ds, quantile_cont(d, 0.75) OVER inside AS p
       FROM (SELECT *, abs(gr - lag(gr) {O}) AS d FROM well_log_long) WINDOW inside AS (PARTITION BY well_id ORDER BY row_seq ROWS BETWEEN 1 FOLLOWING AND 99 FOLLOWING))
     WHERE (row_seq - 1) % 10 = 0 AND m >= 10)) t ON r.well_id = t.well_id AND r.b = t.k""", [], _FW, views=("well_log_long",)))
def fingerprint_windows(spark, sf_dir):
    return shaped(ft.fingerprint_windows(view(spark, sf_dir, "well_log_long"), s=LONG), K, [], _FW)


_WF = ["gr_mean", "gr_std", "gr_p10", "gr_p50", "gr_p90", "gr_range", "gr_skew", "gr_kurt", "gr_sand_frac", "gr_shale_frac", "gr_autocorr1", "gr_autocorr5", "gr_trend_slope", "z_range", "z_std", "z_d1_mean", "z_d1_std", "lateral_length_horiz", "md_total", "tvt_mean", "tvt_std", "tvt_range", "tvt_slope_mean", "tvt_slope_std", "tvt_known_frac"]


@query(oracle(f"""SELECT well_id, avg(gr) AS gr_mean, stddev_samp(gr) AS gr_std, quantile_cont(gr, 0.1) AS gr_p10, quantile_cont(gr, 0.5) AS gr_p50, quantile_cont(gr, 0.9) AS gr_p90, max(gr) - min(gr) AS gr_range, skewness(gr) AS gr_skew, kurtosis(gr) AS gr_kurt,
 avg((gr < 60)::INT) AS gr_sand_frac, avg((gr > 100)::INT) AS gr_shale_frac, {_corr('gr', 'g1', '')} AS gr_autocorr1, {_corr('gr', 'g5', '')} AS gr_autocorr5, regr_slope(gr, row_seq) AS gr_trend_slope, max(z) - min(z) AS z_range, stddev_samp(z) AS z_std, avg(dz) AS z_d1_mean, stddev_samp(dz) AS z_d1_std,
 sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) AS lateral_length_horiz, max(md) - min(md) AS md_total, avg(tvt_input) AS tvt_mean, stddev_samp(tvt_input) AS tvt_std, max(tvt_input) - min(tvt_input) AS tvt_range, coalesce(avg(dt), 0) AS tvt_slope_mean, coalesce(stddev_samp(dt), 0) AS tvt_slope_std, avg((tvt_input IS NOT NULL)::INT) AS tvt_known_frac
 FROM (SELECT *, lag(gr, 1) {O} AS g1, lag(gr, 5) {O} AS g5, z - lag(z) {O} AS dz, tvt_input - lag(tvt_input) {O} AS dt FROM well_log) GROUP BY well_id""", [], _WF, keys=["well_id"]))
def well_fingerprint(spark, sf_dir):
    return shaped(ft.well_fingerprint(log(spark, sf_dir)), ["well_id"], [], _WF)


_GS = ["well_geo_gr_mean", "well_geo_gr_std", "well_geo_gr_max", "well_geo_gr_shale", "well_geo_gr_transitions", "well_geo_facies_change", "well_geo_thickness", "well_geo_complexity", "well_geo_diversity"]


@query(oracle(f"""SELECT l.well_id, l.row_seq, s.* EXCLUDE (well_id), fc * tr AS well_geo_complexity, sh + sa + mu AS well_geo_diversity, sh AS well_geo_gr_shale, tr AS well_geo_gr_transitions, fc AS well_geo_facies_change FROM well_log l LEFT JOIN (
 SELECT well_id, avg(gr) AS well_geo_gr_mean, stddev_samp(gr) AS well_geo_gr_std, max(gr) AS well_geo_gr_max, avg((gr > 100)::INT) AS sh, avg((gr < 60)::INT) AS sa, avg((gr BETWEEN 60 AND 100)::INT) AS mu, avg(t) AS tr, avg(f) AS fc, max(tvt_input) - min(tvt_input) AS well_geo_thickness
 FROM (SELECT *, sum(e) {last(50)} AS t FROM (SELECT *, CASE WHEN abs(gr - lag(gr) {O}) > 20 THEN 1 ELSE 0 END AS e, CASE WHEN abs(tvt_input - lag(tvt_input) {O}) > 1 THEN 1 ELSE 0 END AS f FROM well_log)) GROUP BY well_id) s USING (well_id)""", [], _GS))
def geo_summary_join(spark, sf_dir):
    return shaped(ft.baseline_features(log(spark, sf_dir)), K, [], _GS)


_WS = [f"well_{n}_{k}" for n in ("md", "gr", "z", "tvt") for k in ("min", "max", "mean", "std", "span")] + ["well_known_frac"]


@query(oracle("SELECT well_id, " + ", ".join(f"min({c}) AS well_{n}_min, max({c}) AS well_{n}_max, avg({c}) AS well_{n}_mean, stddev_samp({c}) AS well_{n}_std, max({c}) - min({c}) AS well_{n}_span" for c, n in (("md", "md"), ("gr", "gr"), ("z", "z"), ("tvt_input", "tvt"))) + ", avg((tvt_input IS NOT NULL)::INT) AS well_known_frac, count(*) AS well_n_rows FROM well_log GROUP BY well_id", ["well_n_rows"], _WS, keys=["well_id"]))
def well_summary(spark, sf_dir):
    return shaped(ft.well_summary(log(spark, sf_dir)), ["well_id"], ["well_n_rows"], _WS)


@query(oracle(f"SELECT *, max(tvt_input) {ALL} - min(tvt_input) {ALL} AS thickness FROM well_log", [], ["thickness"]))
def thickness(spark, sf_dir):
    return shaped(log(spark, sf_dir).withColumn("thickness", F.max("tvt_input").over(S.whole) - F.min("tvt_input").over(S.whole)), K, [], ["thickness"])


@query(oracle("SELECT l.well_id, row_seq, coalesce(gr, g) AS gr_global, coalesce(gr, m) AS gr_well FROM well_log l CROSS JOIN (SELECT median(gr) AS g FROM well_log) JOIN (SELECT well_id, median(gr) AS m FROM well_log GROUP BY well_id) USING (well_id)", [], ["gr_global", "gr_well"]))
def median_fill(spark, sf_dir):
    df = log(spark, sf_dir).withColumns({"gr_global": F.col("gr"), "gr_well": F.col("gr")})
    return shaped(ft.median_filled(ft.median_filled(df, ["gr_global"]), ["gr_well"], "well_id"), K, [], ["gr_global", "gr_well"])


@query(oracle("SELECT *, CASE WHEN conf > 0.70 THEN gr ELSE 0 END AS gated FROM (SELECT *, (row_seq % 10) / 10.0 AS conf FROM well_log)", [], ["gated"]))
def confidence_gate(spark, sf_dir):
    df = log(spark, sf_dir).withColumns({"conf": (F.col("row_seq") % 10) / F.lit(10.0), "gated": F.col("gr")})
    return shaped(ft.confidence_gate(df, ["gated"], "conf"), K, [], ["gated"])


@query()
def fingerprint(spark, sf_dir):
    df = ft.fingerprint(view(spark, sf_dir, "well_log_long"), s=LONG)
    return shaped(df, K, [], [c for c in df.columns if c.startswith(("depo_", "well_gr"))])


_TC = ["well_tvt_range", "well_tvt_std"]


@query(oracle(f"SELECT *, CASE WHEN count(tvt_input) {ALL} > 10 THEN max(tvt_input) {ALL} - min(tvt_input) {ALL} ELSE 0 END AS well_tvt_range, CASE WHEN count(tvt_input) {ALL} > 10 THEN stddev_samp(tvt_input) {ALL} ELSE 0 END AS well_tvt_std FROM well_log", [], _TC))
def target_constants(spark, sf_dir):
    return shaped(ft.target_constants(log(spark, sf_dir)), K, [], _TC)


@query(oracle("SELECT *, 0.25 AS prior_a, 3 AS prior_b FROM well_log", [], ["prior_a", "prior_b"]))
def constant_priors(spark, sf_dir):
    """Numeric entries of a record as constant columns; other entries none."""
    return shaped(ft.with_priors(log(spark, sf_dir), {"a": 0.25, "b": 3, "zone": "polar", "real": True}), K, [], ["prior_a", "prior_b"])


_TR = ["md", "gr", "z", "absent"]


@query(oracle("SELECT well_id, row_seq, md, coalesce(gr, 0) AS gr, z, 0 AS absent FROM well_log WHERE tvt_input IS NOT NULL", [], _TR))
def training_rows(spark, sf_dir):
    """Labelled rows with the columns of a model, absent ones and NULLs as 0."""
    rows = log(spark, sf_dir).filter(F.col("tvt_input").isNotNull())
    return shaped(aligned(rows, [*K, *_TR]).fillna(0.0, subset=_TR), K, [], _TR)


_UW = [f"u{k}" for k in range(8)]
_UNIT = "list_transform(a, lambda v: (v - list_avg(a)) / (sqrt(list_sum(list_transform(a, lambda q: (q - list_avg(a)) ** 2))) + 1e-8))"


@query(oracle(f"SELECT well_id, row_seq, {', '.join(f'u[{k + 1}] AS u{k}' for k in range(8))} FROM (SELECT *, {_UNIT} AS u FROM (SELECT *, list(gr) OVER ahead AS a, count(gr) OVER ahead AS m FROM well_log WINDOW ahead AS (PARTITION BY well_id ORDER BY row_seq ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE m = 8 AND (row_seq - 1) % 4 = 0)", [], _UW))
def unit_windows(spark, sf_dir):
    """Complete windows of eight gamma values from every fourth row on, centred and of unit length."""
    found = w.sliding_arrays(log(spark, sf_dir), "gr", 8, 4, "a").withColumn("u", w.unit_centred(F.col("a")))
    return shaped(found.withColumns({f"u{k}": F.get("u", F.lit(k)) for k in range(8)}), K, [], _UW)
