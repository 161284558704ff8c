"""Joins, aggregates, top-k and splits of the series pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEFAULT, SeriesSchema, ratio

#: Rows up to which a side of a distance join is broadcast; beyond it, the search goes through grid cells.
BROADCAST_ROWS = 100_000


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """value by key, the default where there is none."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def typewell(df: DataFrame, s: SeriesSchema = DEFAULT, flag: str = "is_typewell", rows: int = 500) -> DataFrame:
    """Rows of the reference series: those flagged, else those of the series with most readings (least id first),
    else (no series has a reading) the first `rows` rows in the order of series.

    One small job names the series, so that what follows is a scan with a filter."""
    if flag in df.columns:
        return df.filter(F.col(flag) == 1)
    best = df.groupBy(s.well).agg(F.count(s.gr).alias("n")).orderBy(F.desc("n"), s.well).limit(1).first()
    if best and best["n"]:
        return df.filter(F.col(s.well) == F.lit(best[s.well]))
    return df.orderBy(s.well, *s.order).limit(rows)


def first_rows(wells: DataFrame, df: DataFrame, columns: list[str], s: SeriesSchema = DEFAULT) -> DataFrame:
    """Each series of wells once, with the columns of its first row in df (NULL if it has none)."""
    first = df.groupBy(s.well).agg(F.min_by(F.struct(*columns), F.struct(*s.order)).alias("__first"))
    return wells.select(s.well).distinct().join(first, s.well, "left").select(s.well, "__first.*")


def group_sizes(df: DataFrame, by: str) -> DataFrame:
    """by, n."""
    return df.groupBy(by).agg(F.count("*").alias("n"))


def split_wells(df: DataFrame, fraction: float = 0.2, seed: int = 42, s: SeriesSchema = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(training, validation) rows, whole series apart: the max(1, int(n * fraction)) series of least md5(seed, id)."""
    wells = df.select(s.well).distinct().withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(s.well).cast("string")).cast("binary")))
    n = wells.count()
    chosen = wells.orderBy("h").limit(max(1, int(n * fraction))).select(s.well)
    return df.join(chosen, s.well, "left_anti"), df.join(chosen, s.well, "left_semi")


def plane(df: DataFrame, by: str, x: str, y: str, z: str) -> DataFrame:
    """Least-squares plane z = a x + b y + c: dip magnitude (slope) and azimuth (degrees); fewer than three points: 0.

    Points on one line leave the slope across it open: it is 0 (the least slope that fits)."""
    m = df.groupBy(by).agg(F.count("*").alias("n"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"), F.covar_pop(x, z).alias("xz"), F.covar_pop(y, z).alias("yz"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    spread = F.col("xx") + F.col("yy")
    flat = F.abs(det) <= 1e-9 * spread * spread
    solve = lambda u, line: F.when(F.col("n") < 3, F.lit(0.0)).when(flat, F.coalesce(ratio(F.col(line), spread), F.lit(0.0))).otherwise(ratio(u, det))
    m = m.withColumns({"a": solve(F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy"), "xz"), "b": solve(F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy"), "yz")})
    return m.select(by, "a", "b", F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")).alias("dip"), F.pmod(F.degrees(F.atan2("a", "b")), F.lit(360.0)).alias("azimuth"))


def nearest(queries: DataFrame, points: DataFrame, k: int, query_id: str, point_id: str, x: str = "x", y: str = "y") -> DataFrame:
    """The k nearest points of each query: query_id, point columns, d2. Control points are few (their count is checked)."""
    if points.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return nearest_by_cells(queries, points, k, query_id, point_id, x, y)
    p = points.select(*(F.col(c).alias(f"p_{c}") for c in points.columns))
    q = queries.select(F.col(query_id), F.col(x).alias("__x"), F.col(y).alias("__y"))
    d2 = F.pow(F.col("__x") - F.col(f"p_{x}"), 2) + F.pow(F.col("__y") - F.col(f"p_{y}"), 2)
    best = Window.partitionBy(query_id).orderBy("d2", f"p_{point_id}")
    return q.join(F.broadcast(p)).withColumn("d2", d2).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("__x", "__y")


def nearest_by_cells(queries: DataFrame, points: DataFrame, k: int, query_id: str, point_id: str, x: str, y: str, cells: int = 64) -> DataFrame:
    """As nearest(), for many points: rings of grid cells are searched outwards until k points are surely inside."""
    box = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()
    size = max((box["x1"] - box["x0"]) / cells, (box["y1"] - box["y0"]) / cells, 1e-9)
    cell = lambda c, at: F.floor((F.col(c) - at) / size)
    p = points.select(*(F.col(c).alias(f"p_{c}") for c in points.columns)).withColumns({"cx": cell(f"p_{x}", box["x0"]), "cy": cell(f"p_{y}", box["y0"])})
    open_, done, ring = queries.select(query_id, F.col(x).alias("__x"), F.col(y).alias("__y")), None, 1
    while True:
        span = F.explode(F.sequence(F.lit(-ring), F.lit(ring)))
        near = open_.withColumn("i", span).withColumn("j", span)
        near = near.withColumns({"cx": cell("__x", box["x0"]) + F.col("i"), "cy": cell("__y", box["y0"]) + F.col("j")}).drop("i", "j").join(p, ["cx", "cy"])
        near = near.withColumn("d2", F.pow(F.col("__x") - F.col(f"p_{x}"), 2) + F.pow(F.col("__y") - F.col(f"p_{y}"), 2))
        best = Window.partitionBy(query_id).orderBy("d2", f"p_{point_id}")
        near = near.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
        whole = ring > 2 * cells
        sure = near.groupBy(query_id).agg(F.count("*").alias("n"), F.max("d2").alias("m")).filter(F.lit(whole) | ((F.col("n") == k) & (F.col("m") <= (ring * size) ** 2)))
        got = near.join(sure.select(query_id), query_id, "left_semi").drop("__x", "__y", "cx", "cy")
        done = got if done is None else done.unionByName(got)
        open_ = open_.join(sure.select(query_id), query_id, "left_anti")
        if whole or open_.isEmpty():
            return done
        ring *= 2


def inverse_distance(near: DataFrame, query_id: str, z: str, power: float = 2.0) -> DataFrame:
    """Inverse-distance value at each query from nearest()."""
    w = 1 / (F.pow(F.sqrt("d2"), power) + 1e-10)
    return near.groupBy(query_id).agg((F.sum(w * F.col(f"p_{z}")) / F.sum(w)).alias("surface"))


def interpolated(df: DataFrame, table: DataFrame, by: str, x: str, tx: str, ty: str, name: str) -> DataFrame:
    """Piecewise-linear lookup of ty at x in the table (by, tx, ty), ends held: an as-of pair join by one sorted union."""
    t = table.groupBy(by, tx).agg(F.max(ty).alias(ty))
    left = df.select("*", F.col(x).alias("__x"), F.lit(None).cast("double").alias("__y"), F.lit(1).alias("__k"))
    right = t.select(by, F.col(tx).alias("__x"), F.col(ty).alias("__y"), F.lit(0).alias("__k"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy(by).orderBy("__x", "__k")
    point = F.when(F.col("__k") == 0, F.struct(F.col("__x").alias("x"), F.col("__y").alias("y")))
    both = both.withColumns({"__a": F.last(point, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "__b": F.first(point, True).over(order.rowsBetween(0, Window.unboundedFollowing))})
    line = F.col("__a.y") + ratio((F.col("__b.y") - F.col("__a.y")) * (F.col("__x") - F.col("__a.x")), F.col("__b.x") - F.col("__a.x"))
    value = F.coalesce(F.when(F.col("__a.x") == F.col("__b.x"), F.col("__a.y")), line, F.col("__a.y"), F.col("__b.y"))
    return both.filter("__k = 1").withColumn(name, value).drop("__x", "__y", "__k", "__a", "__b")


def nearest_fill(df: DataFrame, sampled: DataFrame, stride: int, value: str, s: SeriesSchema = DEFAULT) -> DataFrame:
    """Values computed at every stride-th row (sampled: well, i, value), at every row: i = round half even(row / stride)."""
    df = df.withColumn("__rn", F.row_number().over(s.ordered) - 1)
    most = sampled.groupBy(s.well).agg(F.max("i").alias("__m"))
    df = df.join(most, s.well, "left").withColumn("i", F.least(F.bround(F.col("__rn") / F.lit(float(stride))).cast("int"), "__m"))
    return df.join(sampled.select(s.well, "i", value), [s.well, "i"], "left").drop("__rn", "__m", "i")


def errors(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """MAE and RMSE over rows where both are there."""
    d = F.col(guess) - F.col(truth)
    return df.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull()).agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.count("*").alias("n"))


def weighted(value: Column, weight: Column) -> tuple[Column, Column]:
    """Weighted mean and variance."""
    mean = F.sum(value * weight) / F.sum(weight)
    return mean, F.sum(weight * value * value) / F.sum(weight) - mean * mean


def top_share(df: DataFrame, category: str) -> DataFrame:
    """Share of each category."""
    n = df.groupBy(category).count()
    return n.select(category, (F.col("count") / F.sum("count").over(Window.partitionBy())).alias("share"))  # one row a category
