"""Queries of matching, continuation and surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as fc
from ..operators import matching as mt
from ..operators import neighbours as nb
from ..operators import relational as rel
from ..operators import surface as sf
from ..operators import windows as w
from ..plans.views import table, view, with_views
from ..schema import DEFAULT as S
from ..sources.files import kept_table, new_folder
from . import query, shape, shaped
from .series import _GAPS, _filled

K = ["well_id", "row_seq"]
#: Formations whose columns fit a row.
MOST_FORMATIONS = 1000
O = "OVER (PARTITION BY well_id ORDER BY row_seq)"


def log(spark, sf_dir):
    return view(spark, sf_dir, "well_log")


_UNIT = "list_transform(embedding, lambda v: v::DOUBLE)"


def _topk(where: str) -> str:
    cosine = "list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"
    return shape(f"SELECT query, vec_id, sim, rank FROM (SELECT q.vec_id AS query, e.vec_id, {cosine} AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({cosine}, 9) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE {where} AND q.vec_id <> e.vec_id) WHERE rank <= 5", ["query", "vec_id"], ["rank"], ["sim"])


@query(_topk("q.vec_id % 50 = 0"))
def cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return shaped(mt.cosine_topk(e.filter("vec_id % 50 = 0"), e, 5, "vec_id", "embedding"), ["query", "vec_id"], ["rank"], ["sim"])


@query(_topk("true"))
def cosine_topk_all(spark, sf_dir):
    """Every embedding against all others."""
    e = table(spark, sf_dir, "embeddings")
    return shaped(mt.cosine_topk(e, e, 5, "vec_id", "embedding"), ["query", "vec_id"], ["rank"], ["sim"])


def _index(spark, sf_dir):
    """An index of the embeddings in a new folder: half of them built, the others appended; opened again."""
    e, path = table(spark, sf_dir, "embeddings"), new_folder(spark, "index")
    nb.EmbeddingIndex.build(e.filter("vec_id % 2 = 0"), path, "vec_id", "embedding", cells=16, recall=0.0)
    return nb.EmbeddingIndex(spark, path).append(e).tuned(0.95, 5), e


@query()
def index_topk(spark, sf_dir):
    """The five nearest rows of every embedding in the cells that the index reads for it."""
    index, e = _index(spark, sf_dir)
    found = index.query(e, 5).withColumnRenamed("score", "sim")
    return shaped(found, ["query", "vec_id"], ["rank"], ["sim"])


@query("SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_keys, true AS reaches_recall FROM embeddings")
def index_recall(spark, sf_dir):
    """What the reopened index holds, and whether it finds 95 % of the true neighbours of all rows."""
    index, e = _index(spark, sf_dir)
    true, found = (df.select("query", "vec_id") for df in (mt.cosine_topk(e, e, 5, "vec_id", "embedding"), index.query(e, 5)))
    true = kept_table(true, "true")  # all pairs, once: read for hits and for their number
    hits = true.join(found, ["query", "vec_id"], "left_semi").agg(F.count("*").alias("hits"))
    wanted, held = true.agg(F.count("*").alias("wanted")), index.rows().agg(F.count("*").alias("n_rows"), F.count_distinct("key").alias("n_keys"))
    return held.crossJoin(hits).crossJoin(wanted).select("n_rows", "n_keys", (F.col("hits") >= 0.95 * F.col("wanted")).alias("reaches_recall"))  # a row each


@query(shape("""WITH u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda v: v / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8)) AS v FROM embeddings),
 p AS (SELECT label AS proto, list(m ORDER BY i) AS p FROM (SELECT label, i, avg(v[i]) AS m FROM u, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1),
 s AS (SELECT vec_id, proto, exp(list_dot_product(v, list_transform(p, lambda x: x / (sqrt(list_dot_product(p, p)) + 1e-8)))) AS e FROM u, p)
 SELECT vec_id, proto, e / sum(e) OVER (PARTITION BY vec_id) AS share FROM s""", ["vec_id", "proto"], [], ["share"]))
def prototype_softmax(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return shaped(mt.prototype_shares(e, mt.prototypes(e, "label", "embedding", 64), "vec_id", "label", "embedding"), ["vec_id", "proto"], [], ["share"])


@query(shape("SELECT vec_id, list_sum(list_resize(embedding::DOUBLE[], 100, 0)) AS total, len(list_resize(embedding::DOUBLE[], 100, 0)) AS n, list_sum(embedding[1:16]::DOUBLE[]) AS head FROM embeddings", ["vec_id"], ["n"], ["total", "head"]))
def pad_truncate(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    wide = mt.padded(F.col("embedding"), 100)
    return shaped(e.withColumns({"total": total(wide), "n": F.size(wide), "head": total(mt.padded(F.col("embedding"), 16))}), ["vec_id"], ["n"], ["total", "head"])


_V = "SELECT well_id, row_seq AS i, md, gr - avg(gr) OVER (PARTITION BY well_id) AS v FROM well_log"
_PICKED = "(SELECT well_id FROM well_log GROUP BY 1 ORDER BY count(gr) DESC, well_id LIMIT 1)"
_THREE = "(SELECT well_id FROM well_log GROUP BY 1 ORDER BY count(gr) DESC, well_id LIMIT 3)"


@query(with_views(shape(f"""WITH v AS ({_V}), r AS (SELECT * FROM v WHERE well_id IN {_PICKED}),
 n AS (SELECT well_id, sqrt(sum(v * v)) AS n FROM v GROUP BY 1), st AS (SELECT well_id, median(d) AS step FROM (SELECT well_id, md - lag(md) OVER (PARTITION BY well_id ORDER BY i) AS d FROM v) GROUP BY 1),
 c AS (SELECT a.well_id, a.i - r.i AS lag, sum(coalesce(a.v, 0) * coalesce(r.v, 0)) AS s FROM v a, r GROUP BY 1, 2),
 b AS (SELECT c.well_id, lag, s / (n.n * (SELECT n.n FROM n WHERE well_id IN {_PICKED})) AS score FROM c JOIN n USING (well_id)),
 k AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY round(abs(score), 9) DESC, lag) AS rank FROM b WHERE isfinite(score))
 SELECT n.well_id, coalesce(lag, 0) AS lag, coalesce(score, 0) AS score, coalesce(lag, 0) * coalesce(step, 0) AS "offset" FROM n LEFT JOIN (SELECT * FROM k WHERE rank = 1) USING (well_id) LEFT JOIN st USING (well_id)""", ["well_id"], ["lag"], ["score", "offset"]).replace("CAST(offset AS DOUBLE) + ", 'CAST("offset" AS DOUBLE) + ').replace(" AS offset", ' AS "offset"'), "well_log"))
def xcorr_lag(spark, sf_dir):
    """Every series against the reference, at all lags."""
    df = log(spark, sf_dir)
    return shaped(mt.correlated(df, rel.typewell(df)), ["well_id"], ["lag"], ["score", "offset"])


_SIMILAR = "least(greatest(coalesce(CASE WHEN stddev_pop(a.gr) * stddev_pop(b.gr) > 1e-12 THEN covar_pop(a.gr, b.gr) / (stddev_pop(a.gr) * stddev_pop(b.gr)) END, 0), 0), 1) AS similarity"


@query(with_views(shape(f"SELECT a.well_id, {_SIMILAR} FROM well_log a JOIN (SELECT row_seq, gr FROM well_log WHERE well_id IN {_PICKED}) b USING (row_seq) WHERE a.gr IS NOT NULL AND b.gr IS NOT NULL GROUP BY 1", ["well_id"], [], ["similarity"]), "well_log"))
def strat_similarity(spark, sf_dir):
    df = log(spark, sf_dir)
    return shaped(mt.similarity(df, rel.typewell(df)), ["well_id"], [], ["similarity"])


@query(with_views(shape(f"SELECT well_id, candidate, similarity FROM (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY round(similarity, 9) DESC, candidate) AS rank FROM (SELECT a.well_id, b.well_id AS candidate, {_SIMILAR} FROM well_log a JOIN (SELECT * FROM well_log WHERE well_id IN {_THREE}) b USING (row_seq) WHERE a.gr IS NOT NULL AND b.gr IS NOT NULL AND a.well_id <> b.well_id GROUP BY 1, 2)) WHERE rank = 1", ["well_id"], ["candidate"], ["similarity"]), "well_log"))
def best_typewell(spark, sf_dir):
    """The most similar of the three series with most readings, for every other series."""
    df = log(spark, sf_dir)
    three = df.groupBy("well_id").agg(F.count("gr").alias("n")).orderBy(F.desc("n"), "well_id").limit(3).select("well_id")
    return shaped(mt.best_typewell(df, df.join(F.broadcast(three), "well_id", "left_semi")), ["well_id"], ["candidate"], ["similarity"])


_FLAT = "SELECT *, tvt - 1 AS physics_tvt, gr - avg(gr) OVER (PARTITION BY well_id ORDER BY row_seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS spike"


@query(with_views(shape(f"SELECT *, abs(spike) AS res_gr_spike, coalesce(g1 - lag(g1) {O}, 0) AS res_gr_accel, coalesce(z1 - lag(z1) {O}, 0) AS res_z_accel, coalesce(abs(physics_tvt - lag(physics_tvt) {O}), 0) AS res_physics_uncertainty FROM ({_FLAT}, gr - lag(gr) {O} AS g1, z - lag(z) {O} AS z1 FROM well_log)", K, [], list(fc.RESIDUALS)), "well_log"))
def residual_features(spark, sf_dir):
    return shaped(fc.residual_features(log(spark, sf_dir).withColumn("physics_tvt", F.col("tvt") - 1)), K, [], list(fc.RESIDUALS))


_NEXT = "lag(well_id, o) OVER w AS other, lag(m, o) OVER w AS n FROM m, (SELECT unnest([1, 2, -1, -2]) AS o) WINDOW w AS (PARTITION BY o ORDER BY m, well_id)"


@query(with_views(shape(f"""WITH r AS (SELECT *, tvt_input IS NOT NULL AS k, row_number() OVER (PARTITION BY well_id, tvt_input IS NOT NULL ORDER BY row_seq) AS step, row_number() OVER (PARTITION BY well_id, tvt_input IS NOT NULL ORDER BY row_seq DESC) AS back FROM well_log),
 m AS (SELECT well_id, avg(gr ORDER BY row_seq) AS m FROM well_log GROUP BY 1 HAVING m IS NOT NULL), c AS (SELECT well_id, other, 1 / (1 + abs(m - n)) AS score FROM (SELECT well_id, m, {_NEXT}) WHERE other IS NOT NULL),
 e AS (SELECT well_id, max(tvt_input) FILTER (back = 1) AS last, max(tvt_input) FILTER (back = 5) AS fifth, max(tvt_input) FILTER (step = 1) AS first, count(*) AS have FROM r WHERE k GROUP BY 1),
 q AS (SELECT well_id, count(*) AS need FROM r WHERE NOT k GROUP BY 1),
 v AS (SELECT x.well_id, x.row_seq, c.other, score, t.tvt_input - f.first + e.last AS v FROM r x JOIN q USING (well_id) JOIN e USING (well_id) JOIN c ON c.well_id = x.well_id JOIN e f ON f.well_id = c.other AND f.have >= need JOIN r t ON t.well_id = c.other AND t.k AND t.step = x.step WHERE NOT x.k),
 h AS (SELECT well_id, row_seq, count(*) AS n, sum(v * score ORDER BY other) / sum(score ORDER BY other) AS m FROM v GROUP BY 1, 2),
 g AS (SELECT well_id, row_seq, m, CASE WHEN n = 1 THEN 0.3 ELSE sqrt(sum(score * (v - m) * (v - m) ORDER BY other) / sum(score ORDER BY other)) END AS d FROM v JOIN h USING (well_id, row_seq) GROUP BY well_id, row_seq, m, n),
 a AS (SELECT DISTINCT well_id FROM c)
 SELECT x.well_id, x.row_seq, coalesce(g.m, CASE WHEN a.well_id IS NULL THEN e.last ELSE e.last + coalesce((e.last - fifth) / 4, 0) * step END) AS transfer, coalesce(g.d, CASE WHEN a.well_id IS NULL THEN 1.0 ELSE 0.5 END) AS transfer_sigma FROM r x LEFT JOIN e USING (well_id) LEFT JOIN a USING (well_id) LEFT JOIN g ON g.well_id = x.well_id AND g.row_seq = x.row_seq WHERE NOT x.k""", K, [], ["transfer", "transfer_sigma"]), "well_log"))
def well_transfer(spark, sf_dir):
    df = log(spark, sf_dir)
    return shaped(fc.transferred(df, fc.similar_wells(df, 2)), K, [], ["transfer", "transfer_sigma"])


_OWN = "OVER (PARTITION BY well_id, tvt_input IS NOT NULL ORDER BY row_seq)"
_SLOPE = "CASE WHEN stddev_pop(CASE WHEN {rows} THEN {x} END) > {least} THEN coalesce(regr_slope(CASE WHEN {rows} THEN {y} END, CASE WHEN {rows} THEN {x} END), 0) ELSE 0 END"
_STEP = "least(greatest(0.3 * r.raw + 0.7 * p.change, -3), 3)"
_CONTINUED = f"""WITH RECURSIVE g AS (SELECT *, coalesce({_filled("gr", 5)}, median(gr) OVER (PARTITION BY well_id), 0) AS g FROM (SELECT *, {_GAPS} FROM well_log)),
 c AS (SELECT *, CASE WHEN tvt_input IS NOT NULL THEN tvt_input - lag(tvt_input) {_OWN} END AS y1, CASE WHEN tvt_input IS NOT NULL THEN g - lag(g) {_OWN} END AS g1, coalesce(z - lag(z) OVER o, 0) AS dz, coalesce(g - lag(g) OVER o, 0) AS dg,
   CASE WHEN tvt_input IS NOT NULL THEN count(tvt_input) OVER (PARTITION BY well_id ORDER BY row_seq DESC) END AS k FROM g WINDOW o AS (PARTITION BY well_id ORDER BY row_seq)),
 t AS (SELECT well_id, {_SLOPE.format(rows="k <= 20", x="-k", y="tvt_input", least=0)} AS trend, {_SLOPE.format(rows="k <= 20", x="z", y="tvt_input", least=0.01)} AS dip, {_SLOPE.format(rows="k <= 19", x="g1", y="y1", least=0.1)} AS gamma,
   count(tvt_input) AS many, coalesce(arg_max(tvt_input, row_seq) FILTER (tvt_input IS NOT NULL), 0) AS start, arg_min(tvt_input, row_seq) FILTER (tvt_input IS NOT NULL) AS first FROM c GROUP BY 1),
 r AS MATERIALIZED (SELECT well_id, row_seq, tvt_input AS v, trend, many, start, 0.5 * trend + 0.3 * dip * dz + 0.2 * gamma * dg AS raw FROM c JOIN t USING (well_id)),
 p AS (SELECT well_id, 0::BIGINT AS row_seq, coalesce(first, start) AS physics_tvt, trend AS change, 0 AS n, 1.0::DOUBLE AS physics_confidence FROM t
  UNION ALL SELECT r.well_id, r.row_seq, CASE WHEN v IS NOT NULL THEN v WHEN many < 2 THEN start ELSE p.physics_tvt + {_STEP} END, CASE WHEN v IS NOT NULL THEN trend ELSE {_STEP} END, CASE WHEN v IS NOT NULL THEN 0 ELSE p.n + 1 END,
   CASE WHEN v IS NOT NULL THEN 1 WHEN many < 2 THEN 0.1 ELSE exp(-0.05 * p.n) END FROM p JOIN r ON r.well_id = p.well_id AND r.row_seq = p.row_seq + 1)
 SELECT * FROM p WHERE row_seq > 0"""


@query(with_views(shape(_CONTINUED, K, [], ["physics_tvt", "physics_confidence"]), "well_log"))
def physics_continuation(spark, sf_dir):
    return shaped(fc.physics(log(spark, sf_dir)), K, [], ["physics_tvt", "physics_confidence"])


@query()
def continuation_ensemble(spark, sf_dir):
    df = log(spark, sf_dir)
    return shaped(fc.continued(df, fc.transferred(df, fc.similar_wells(df, 2))), K, [], ["TVT_pred_kalman", "TVT_pred_ar", "TVT_pred_transfer", "TVT_pred_ensemble", "TVT_uncertainty"])


@query()
def hybrid_continuation(spark, sf_dir):
    return shaped(fc.hybrid(log(spark, sf_dir), trees=5), K, [], ["physics_tvt", "physics_confidence", "residual", "hybrid_tvt"])


@query()
def dtw_align(spark, sf_dir):
    df = log(spark, sf_dir)
    return shaped(mt.aligned(df, rel.typewell(df), [100.0, 300.0, 500.0]), K, [], ["aligned_depth", "alignment_score", "gr_deviation", "formation_proximity"])


@query()
def window_match(spark, sf_dir):
    """Match columns at every row: computed at every tenth, spread by nearest sample."""
    df = log(spark, sf_dir)
    found = mt.window_matches(df, rel.typewell(df))
    names = [c for c in found.columns if c.startswith("tw_")]
    wide = df
    sampled = found.select("well_id", "i", F.struct(*names).alias("m"))
    wide = rel.nearest_fill(wide, sampled, 10, "m").select(*K, "md", "tvt_input", "m.*")
    wide = wide.withColumn("tw_tvt_vs_ffill", F.col("tw_best_tvt") - w.filled_forward("tvt_input"))
    return shaped(wide, K, [], [*names, "tw_tvt_vs_ffill"])


#: The three best readings of each series at least five rows apart, among its fifteen best: as nested lists.
_PICKS = """a AS (SELECT well_id, list({'s': gr, 'i': row_seq, 'v': tvt} ORDER BY gr DESC, row_seq)[1:15] AS p FROM well_log WHERE gr IS NOT NULL GROUP BY 1),
 b AS (SELECT well_id, p[1] AS p1, list_filter(p, lambda x: abs(x.i - p[1].i) >= 5) AS q FROM a),
 c AS (SELECT well_id, p1, q[1] AS p2, list_filter(q, lambda x: abs(x.i - q[1].i) >= 5)[1] AS p3 FROM b)"""


def _scored(spark, sf_dir):
    entry = F.struct(F.col("gr").alias("score"), F.col("row_seq").cast("int").alias("i"), F.col("tvt").alias("value"))
    return log(spark, sf_dir).filter("gr is not null").groupBy("well_id").agg(F.collect_list(entry).alias("a"))


@query(with_views(f"SELECT well_id, CAST(rank AS INT) AS rank, CAST(p.i AS INT) AS i, p.s AS score FROM (SELECT well_id, unnest([0, 1, 2]) AS rank, unnest([p1, p2, p3]) AS p FROM (WITH {_PICKS} SELECT * FROM c)) WHERE p IS NOT NULL", "well_log"))
def separated_topk(spark, sf_dir):
    """The three best readings of each series at least five rows apart, by one fold over the sorted scores."""
    return _scored(spark, sf_dir).select("well_id", F.posexplode(mt.top_separated(F.col("a"), 3, 5)).alias("rank", "x")).select("well_id", "rank", "x.i", "x.score")


_SUMMARY = ["best_value", "best_score", "second_value", "weighted_value", "spread", "confidence"]


@query(with_views(shape(f"""SELECT well_id, p1.v AS best_value, p1.s AS best_score, v2 AS second_value, (greatest(p1.s, 0) + 1e-9) * p1.v + (greatest(s2, 0) + 1e-9) * v2 + (greatest(s3, 0) + 1e-9) * v3 AS w, weighted / weights AS weighted_value, spread, greatest(p1.s, 0) AS confidence FROM (
 SELECT *, (greatest(p1.s, 0) + 1e-9) * p1.v + (greatest(s2, 0) + 1e-9) * v2 + (greatest(s3, 0) + 1e-9) * v3 AS weighted, greatest(p1.s, 0) + greatest(s2, 0) + greatest(s3, 0) + 3e-9 AS weights, list_stddev_pop([p1.v, v2, v3]) AS spread FROM (
 SELECT well_id, p1, coalesce(p2, p1).v AS v2, coalesce(p2, p1).s AS s2, coalesce(p3, p2, p1).v AS v3, coalesce(p3, p2, p1).s AS s3 FROM (WITH {_PICKS} SELECT * FROM c)))""", ["well_id"], [], _SUMMARY), "well_log"))
def separated_summary(spark, sf_dir):
    """What the three separated best readings of each series say of the target."""
    df = _scored(spark, sf_dir)
    return shaped(df.select("well_id", *(c.alias(n) for n, c in mt.topk_summary(F.col("a"), 3, 5).items())), ["well_id"], [], _SUMMARY)


@query()
def hybrid_reloaded(spark, sf_dir):
    """The hybrid's learner fitted, saved, loaded again and applied."""
    df, path = log(spark, sf_dir), new_folder(spark, "hybrid")
    fc.HybridEstimator(trees=5).fit(df).save(spark, path)
    return shaped(fc.HybridModel.load(spark, path).predict(df), K, [], ["physics_tvt", "physics_confidence", "residual", "hybrid_tvt"])


@query()
def tps_surface(spark, sf_dir):
    tops = view(spark, sf_dir, "tops")
    points = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 1.5).alias("x"), (F.col("n_nationkey") * 2.1).alias("y"))
    return shaped(sf.evaluated(points, sf.fitted(tops)), ["n_nationkey", "formation"], [], ["surface"])


def _places(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 37).cast("double").alias("x"), (F.col("s_suppkey") % 53).cast("double").alias("y"), F.lit(-1000.0).alias("z"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_acctbal").cast("double")).alias("tvt_input"))


@query()
def formation_features(spark, sf_dir):
    """Expected depth, distance, thickness and dip correction of every formation at every place."""
    tops = view(spark, sf_dir, "tops")
    names = sorted(r[0] for r in tops.select("formation").distinct().limit(MOST_FORMATIONS + 1).collect())
    if len(names) > MOST_FORMATIONS:
        raise ValueError(f"a wide row has the columns of at most {MOST_FORMATIONS} formations")
    out = sf.formation_features(_places(spark, sf_dir), tops, ["s_suppkey"], names, target="tvt_input")
    return shaped(out, ["s_suppkey"], [], [c for c in out.columns if c != "s_suppkey"])


_PLANE = "SELECT formation, CASE WHEN n < 3 THEN 0 WHEN abs(xx * yy - xy * xy) <= 1e-9 * (xx + yy) ** 2 THEN coalesce(xz / nullif(xx + yy, 0), 0) ELSE (xz * yy - yz * xy) / (xx * yy - xy * xy) END AS a, CASE WHEN n < 3 THEN 0 WHEN abs(xx * yy - xy * xy) <= 1e-9 * (xx + yy) ** 2 THEN coalesce(yz / nullif(xx + yy, 0), 0) ELSE (yz * xx - xz * xy) / (xx * yy - xy * xy) END AS b FROM (SELECT formation, count(*) AS n, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, depth) AS xz, covar_pop(y, depth) AS yz FROM tops GROUP BY 1)"


@query(with_views(shape(f"SELECT s_suppkey, formation, sqrt(a * a + b * b) AS dip, CASE WHEN sqrt(a * a + b * b) > 0 THEN a * (s_suppkey % 37) + b * (s_suppkey % 53) END AS dip_corr FROM supplier, ({_PLANE})", ["s_suppkey", "formation"], [], ["dip", "dip_corr"]), "tops"))
def dip_corrections(spark, sf_dir):
    """What the dip of every formation adds at every place."""
    return shaped(sf.dip_corrections(_places(spark, sf_dir), view(spark, sf_dir, "tops"), ["s_suppkey"]), ["s_suppkey", "formation"], [], ["dip", "dip_corr"])


@query()
def structural_context(spark, sf_dir):
    """Expected depth and dip of every formation at the place of every nation."""
    places = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 1.5).alias("x"), (F.col("n_nationkey") * 2.1).alias("y"))
    return shaped(sf.structural_context(places, view(spark, sf_dir, "tops"), ["n_nationkey"]), ["n_nationkey", "formation"], [], ["pred", "dip"])


@query()
def thickness_surface(spark, sf_dir):
    """Base surface less top surface of every formation at every place."""
    tops = view(spark, sf_dir, "tops")
    top, base = sf.fitted(tops), sf.fitted(tops, "base_depth")
    return shaped(sf.thickness_between(_places(spark, sf_dir), top, base, ["s_suppkey"]), ["s_suppkey", "formation"], [], ["thickness"])
