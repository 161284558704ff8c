"""Queries of joins, aggregates, splits, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import relational as rel
from ..operators import surface as sf
from ..operators import windows as w
from ..plans.views import table, view, with_views
from ..schema import DEFAULT as S
from . import query, shape, shaped

K = ["well_id", "row_seq"]


def log(spark, sf_dir):
    return view(spark, sf_dir, "well_log")


def tops(spark, sf_dir):
    return view(spark, sf_dir, "tops")


FLAGSHIP = with_views(shape("""SELECT w.well_id, count(*) AS n_rows, avg(gr) AS gr_mean, coalesce(stddev_samp(gr), 0) AS gr_std, avg((gr > 100)::INT) AS shale, avg(abs(gr - m5)) AS mae, avg(abs(d)) AS mean_change
 FROM (SELECT *, avg(gr) OVER (PARTITION BY well_id ORDER BY row_seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m5, gr - lag(gr) OVER (PARTITION BY well_id ORDER BY row_seq) AS d FROM well_log) w GROUP BY 1""", ["well_id"], ["n_rows"], ["gr_mean", "gr_std", "shale", "mae", "mean_change"]), "well_log")


@query(FLAGSHIP)
def well_profile(spark, sf_dir):
    """Flags, rolling mean, change, summary and error of each series, from one scan and one exchange."""
    df = w.rolling(ft.gr_flags(log(spark, sf_dir)), "gr", ("mean",), (5,), "r")
    df = df.withColumn("d", F.col("gr") - F.lag("gr").over(S.ordered))
    out = df.groupBy("well_id").agg(F.count("*").alias("n_rows"), F.avg("gr").alias("gr_mean"), F.coalesce(F.stddev_samp("gr"), F.lit(0.0)).alias("gr_std"), F.avg("gr_shale").alias("shale"), F.avg(F.abs(F.col("gr") - F.col("r_mean_5"))).alias("mae"), F.avg(F.abs("d")).alias("mean_change"))
    return shaped(out, ["well_id"], ["n_rows"], ["gr_mean", "gr_std", "shale", "mae", "mean_change"])


_PICK = "(SELECT well_id FROM well_log GROUP BY 1 ORDER BY count(gr) DESC, well_id LIMIT 1)"


@query(with_views(f"SELECT well_id, row_seq, gr FROM well_log WHERE well_id IN {_PICK}", "well_log"))
def typewell_pick(spark, sf_dir):
    return rel.typewell(log(spark, sf_dir)).select(*K, "gr")


@query(with_views("SELECT well_id, row_seq, CASE WHEN well_id IN (SELECT well_id FROM (SELECT DISTINCT well_id FROM well_log) ORDER BY md5('42:' || well_id) LIMIT (SELECT greatest(1, (count(DISTINCT well_id) * 0.2)::INT) FROM well_log)) THEN 'validation' ELSE 'training' END AS part FROM well_log", "well_log"))
def split_wells(spark, sf_dir):
    train, val = rel.split_wells(log(spark, sf_dir))
    return train.select(*K, F.lit("training").alias("part")).unionByName(val.select(*K, F.lit("validation").alias("part")))


@query(with_views(shape("SELECT well_id, unnest(['lower', 'upper']) AS zone, unnest([quantile_cont(tvt_input, 0.25), quantile_cont(tvt_input, 0.75)]) AS depth FROM well_log GROUP BY 1 HAVING count(tvt_input) >= 10", ["well_id", "zone"], [], ["depth"]), "well_log"))
def synthetic_tops(spark, sf_dir):
    q = log(spark, sf_dir).groupBy("well_id").agg(F.count("tvt_input").alias("n"), *(F.percentile("tvt_input", F.lit(p)).alias(c) for p, c in ((0.25, "lower"), (0.75, "upper")))).filter("n >= 10")
    return shaped(q.unpivot(["well_id"], ["lower", "upper"], "zone", "depth"), ["well_id", "zone"], [], ["depth"])


@query(with_views(shape("SELECT formation, sqrt(a * a + b * b) AS dip, (degrees(atan2(a, b)) + 360) % 360 AS azimuth FROM (SELECT formation, CASE WHEN abs(xx * yy - xy * xy) <= 1e-9 * (xx + yy) ** 2 THEN xz / (xx + yy) ELSE (xz * yy - yz * xy) / (xx * yy - xy * xy) END AS a, CASE WHEN abs(xx * yy - xy * xy) <= 1e-9 * (xx + yy) ** 2 THEN yz / (xx + yy) ELSE (yz * xx - xz * xy) / (xx * yy - xy * xy) END AS b FROM (SELECT formation, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, depth) AS xz, covar_pop(y, depth) AS yz FROM tops GROUP BY 1))", ["formation"], [], ["dip", "azimuth"]), "tops"))
def plane_dip(spark, sf_dir):
    return shaped(rel.plane(tops(spark, sf_dir), "formation", "x", "y", "depth"), ["formation"], [], ["dip", "azimuth"])


_QUERY = "(SELECT n_nationkey AS q, CAST(n_nationkey * 1.5 AS DOUBLE) AS x, CAST(n_nationkey * 2.1 AS DOUBLE) AS y FROM nation)"
_POINTS = "(SELECT well_id, x, y, sum(depth) AS z FROM tops GROUP BY ALL)"


@query(with_views(shape(f"SELECT q, sum(w * z) / sum(w) AS surface FROM (SELECT q.q, p.z, 1 / ((q.x - p.x) ** 2 + (q.y - p.y) ** 2 + 1e-10) AS w, row_number() OVER (PARTITION BY q.q ORDER BY (q.x - p.x) ** 2 + (q.y - p.y) ** 2, p.well_id) AS r FROM {_QUERY} q, {_POINTS} p) WHERE r <= 5 GROUP BY 1", ["q"], [], ["surface"]), "tops"))
def idw_surface(spark, sf_dir):
    q = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("q"), (F.col("n_nationkey") * 1.5).alias("x"), (F.col("n_nationkey") * 2.1).alias("y"))
    points = tops(spark, sf_dir).groupBy("well_id", "x", "y").agg(F.sum("depth").alias("z"))
    return shaped(rel.inverse_distance(rel.nearest(q, points, 5, "q", "well_id"), "q", "z"), ["q"], [], ["surface"])


@query(with_views(shape("SELECT formation, avg(depth) AS level FROM tops GROUP BY 1", ["formation"], [], ["level"]), "tops"))
def constant_surface(spark, sf_dir):
    return shaped(sf.constant(tops(spark, sf_dir)), ["formation"], [], ["level"])


@query(with_views(shape("SELECT well_id, formation, greatest(base_depth - depth, 0) AS thick FROM tops", ["well_id", "formation"], [], ["thick"]), "tops"))
def thickness_map(spark, sf_dir):
    return shaped(tops(spark, sf_dir).withColumn("thick", F.greatest(F.col("base_depth") - F.col("depth"), F.lit(0.0))), ["well_id", "formation"], [], ["thick"])


@query(with_views(shape("SELECT well_id, avg(x) AS mean_x, avg(y) AS mean_y FROM well_log GROUP BY 1", ["well_id"], [], ["mean_x", "mean_y"]), "well_log"))
def mean_xy(spark, sf_dir):
    return shaped(log(spark, sf_dir).groupBy("well_id").agg(F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y")), ["well_id"], [], ["mean_x", "mean_y"])


@query(with_views("SELECT well_id, formation, arg_min(md, row_seq) AS top FROM well_log GROUP BY 1, 2", "well_log"))
def first_top(spark, sf_dir):
    return log(spark, sf_dir).groupBy("well_id", "formation").agg(F.min_by("md", "row_seq").alias("top"))


@query(with_views("SELECT t.well_id, t.formation, s.s_nationkey AS nation FROM tops t LEFT JOIN supplier s ON t.well_id = s.s_suppkey", "tops"))
def tops_left_join(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("well_id"), F.col("s_nationkey").alias("nation"))
    return tops(spark, sf_dir).join(s, "well_id", "left").select("well_id", "formation", "nation")


@query("SELECT s_suppkey, n.n_name, r_name FROM supplier s JOIN (SELECT * FROM nation ORDER BY n_nationkey LIMIT 5) n ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def lateral_units(spark, sf_dir):
    """Units of the first five columns, one record each."""
    first = table(spark, sf_dir, "nation").filter("n_nationkey is not null").orderBy("n_nationkey").limit(5)
    units = table(spark, sf_dir, "supplier").join(F.broadcast(first), F.col("s_nationkey") == F.col("n_nationkey"))  # five rows
    return units.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@query(shape("SELECT p_type, count(*) / sum(count(*)) OVER () AS share FROM part GROUP BY 1", ["p_type"], [], ["share"]))
def cat_share(spark, sf_dir):
    return shaped(rel.top_share(table(spark, sf_dir, "part"), "p_type"), ["p_type"], [], ["share"])


@query("SELECT p_brand, min(least(p_size, p_partkey)) AS age_min, max(greatest(p_size, p_partkey)) AS age_max FROM part GROUP BY 1")
def age_range(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min(F.least(F.col("p_size").cast("long"), "p_partkey")).alias("age_min"), F.max(F.greatest(F.col("p_size").cast("long"), "p_partkey")).alias("age_max"))


@query("SELECT p_size AS size, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS kinds, count(DISTINCT p_type) AS n_kinds, arg_min(p_name, p_partkey) AS first_name FROM part GROUP BY 1")
def collect_sets(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("size")).agg(F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("kinds"), F.count_distinct("p_type").alias("n_kinds"), F.min_by("p_name", "p_partkey").alias("first_name"))


@query(with_views("SELECT l.well_id, row_seq, coalesce(c.cluster, -1) AS cluster FROM well_log l LEFT JOIN (SELECT s_suppkey AS well_id, CAST(s_nationkey AS INT) AS cluster FROM supplier) c USING (well_id)", "well_log"))
def cluster_lookup(spark, sf_dir):
    labels = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("well_id"), F.col("s_nationkey").cast("int").alias("cluster"))
    return rel.lookup(log(spark, sf_dir), labels, "well_id", "cluster", -1).select(*K, "cluster")


@query(with_views("SELECT well_id, row_seq, CASE WHEN well_id % 7 = 0 THEN 'reference' ELSE 'lateral' END AS role FROM well_log", "well_log"))
def flag_partition(spark, sf_dir):
    df = log(spark, sf_dir).withColumn("is_typewell", (F.col("well_id") % 7 == 0).cast("int"))
    one, rest = df.filter("is_typewell = 1"), df.filter("is_typewell <> 1")
    return one.select(*K, F.lit("reference").alias("role")).unionByName(rest.select(*K, F.lit("lateral").alias("role")))


@query(with_views(shape("SELECT avg(abs(tvt_input - z)) AS mae, sqrt(avg((tvt_input - z) ** 2)) AS rmse, count(tvt_input) AS n FROM well_log", [], ["n"], ["mae", "rmse"]), "well_log"))
def mae_rmse(spark, sf_dir):
    return shaped(rel.errors(log(spark, sf_dir), "z", "tvt_input"), [], ["n"], ["mae", "rmse"])


@query(shape("SELECT p_brand, sum(p_retailprice * p_size) / sum(p_size) AS w_mean, sum(p_size * p_retailprice * p_retailprice) / sum(p_size) - (sum(p_retailprice * p_size) / sum(p_size)) ** 2 AS w_var FROM part GROUP BY 1", ["p_brand"], [], ["w_mean", "w_var"]))
def weighted_stats(spark, sf_dir):
    mean, var = rel.weighted(F.col("p_retailprice"), F.col("p_size").cast("double"))
    return shaped(table(spark, sf_dir, "part").groupBy("p_brand").agg(mean.alias("w_mean"), var.alias("w_var")), ["p_brand"], [], ["w_mean", "w_var"])


@query(with_views(shape("""SELECT l.well_id, l.row_seq, CASE WHEN a.x = b.x THEN a.y ELSE coalesce(a.y + (b.y - a.y) * (l.x - a.x) / (b.x - a.x), a.y, b.y) END AS value FROM well_log l
 ASOF LEFT JOIN (SELECT well_id, x, max(tvt) AS y FROM well_log WHERE row_seq % 5 = 0 GROUP BY 1, 2) a ON l.well_id = a.well_id AND l.x >= a.x
 ASOF LEFT JOIN (SELECT well_id, x, max(tvt) AS y FROM well_log WHERE row_seq % 5 = 0 GROUP BY 1, 2) b ON l.well_id = b.well_id AND l.x <= b.x""", K, [], ["value"]), "well_log"))
def asof_interp(spark, sf_dir):
    df = log(spark, sf_dir)
    points = df.filter("row_seq % 5 = 0").select("well_id", F.col("x").alias("tx"), F.col("tvt").alias("ty"))
    return shaped(rel.interpolated(df, points, "well_id", "x", "tx", "ty", "value"), K, [], ["value"])


@query(with_views(shape("SELECT l.well_id, l.row_seq, s.gr AS value FROM (SELECT *, least(round_even((row_seq - 1) / 10.0, 0)::INT, m) AS i FROM well_log JOIN (SELECT well_id, (max(row_seq) - 1) // 10 AS m FROM well_log GROUP BY 1) USING (well_id)) l LEFT JOIN (SELECT *, (row_seq - 1) // 10 AS i FROM well_log WHERE (row_seq - 1) % 10 = 0) s ON l.well_id = s.well_id AND l.i = s.i", K, [], ["value"]), "well_log"))
def nearest_fill(spark, sf_dir):
    df = log(spark, sf_dir)
    sampled = df.filter("(row_seq - 1) % 10 = 0").select("well_id", ((F.col("row_seq") - 1) / 10).cast("int").alias("i"), F.col("gr").alias("value"))
    return shaped(rel.nearest_fill(df, sampled, 10, "value"), K, [], ["value"])


@query("SELECT DISTINCT p_type, p_brand FROM part UNION ALL SELECT 'all', 'all'")
def distinct_union(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_type", "p_brand").dropDuplicates().unionByName(spark.sql("SELECT 'all' AS p_type, 'all' AS p_brand"))


@query("SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_wells FROM events")
def counts(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("n_wells"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def top_k(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20)


@query(shape("SELECT name, mae, (first_value(mae) OVER (ORDER BY step) - mae) / first_value(mae) OVER (ORDER BY step) * 100 AS lift FROM (SELECT p_brand AS name, min(p_partkey) AS step, avg(p_retailprice) AS mae FROM part GROUP BY 1)", ["name"], [], ["mae", "lift"]))
def ablation_lift(spark, sf_dir):
    """Error of each step and its lift over the first, in percent."""
    from ..operators.models import lift

    steps = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("step"), F.avg("p_retailprice").alias("mae"))
    return shaped(lift(steps, "step", "mae"), ["name"], [], ["mae", "lift"])


_STEPS = "SELECT *, (first_value(mae) OVER (ORDER BY step) - mae) / first_value(mae) OVER (ORDER BY step) * 100 AS lift FROM (SELECT p_brand AS name, min(p_partkey) AS step, avg(p_retailprice) AS mae, max(p_retailprice) AS rmse, count(*) AS n_features FROM part GROUP BY 1)"


def _steps(spark, sf_dir):
    from ..operators.models import lift

    part = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name"))
    return lift(part.agg(F.min("p_partkey").alias("step"), F.avg("p_retailprice").alias("mae"), F.max("p_retailprice").alias("rmse"), F.count("*").alias("n_features")), "step", "mae")


@query(shape(f"SELECT name, lift FROM ({_STEPS}) ORDER BY lift DESC, name LIMIT 1", ["name"], [], ["lift"]))
def best_step(spark, sf_dir):
    """The step that gains most over the first."""
    from ..operators.models import best

    return shaped(best(_steps(spark, sf_dir)), ["name"], [], ["lift"])


@query(f"""WITH s AS ({_STEPS}) SELECT CAST(step AS BIGINT) AS step, printf('%-35s MAE=%.4f  RMSE=%.4f  Lift=%s%.1f%%  Features=%d', name, mae, rmse, CASE WHEN lift > 0 THEN '+' ELSE '' END, lift, n_features) AS line FROM s
 UNION ALL SELECT (SELECT CAST(max(step) + 1 AS BIGINT) FROM s), printf('best: %s (%s%.1f%%)', name, CASE WHEN lift > 0 THEN '+' ELSE '' END, lift) FROM (SELECT * FROM s ORDER BY lift DESC, name LIMIT 1)""")
def ablation_report(spark, sf_dir):
    """Steps as lines of text, and the best of them."""
    from ..operators.models import report

    return report(_steps(spark, sf_dir))


@query(with_views(shape("SELECT c.c_custkey AS well_id, l.md, l.gr, l.z FROM customer c LEFT JOIN (SELECT * FROM well_log WHERE row_seq = 1) l ON c.c_custkey = l.well_id", ["well_id"], [], ["md", "gr", "z"]), "well_log"))
def first_rows(spark, sf_dir):
    """Every customer as a series, with the first row of its log."""
    wells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("well_id"))
    return shaped(rel.first_rows(wells, log(spark, sf_dir), ["md", "gr", "z"]), ["well_id"], [], ["md", "gr", "z"])


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def group_sizes(spark, sf_dir):
    return rel.group_sizes(table(spark, sf_dir, "customer"), "c_mktsegment")
