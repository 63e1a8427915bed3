"""Neighbour join and local geometry queries."""

from pyspark.sql import functions as F

from pointweave.functions.maths import six_digits
from pointweave.operators import geometry as geo, neighbours as op, tables

from . import fixtures as fx
from .registry import case

six = fx.six
D2 = "(q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y)+(q.z-s.z)*(q.z-s.z)"
PAIRS = f"pr AS (SELECT q.scan_id, q.point_id AS query_id, s.point_id, {D2} AS d2 FROM cloud q JOIN cloud s ON q.scan_id=s.scan_id)"
NEAR = f"nn AS MATERIALIZED (SELECT scan_id, query_id, CAST(rank AS INTEGER) AS rank, point_id, d2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, point_id) AS rank FROM pr) WHERE rank<=8)"


def near8(spark, sf, k=8):
    c = fx.cloud(spark, sf)
    return op.knn_join(c.withColumnRenamed("point_id", "query_id"), c, k)


@case("D1_radius_join", f"WITH {PAIRS} SELECT * FROM pr WHERE d2<=0.0625", "cloud")
def radius_join(spark, sf):
    c = fx.cloud(spark, sf)
    return op.ball_join(c.withColumnRenamed("point_id", "query_id"), c, 0.25, None)


@case("D1_radius_join_nearest", f"WITH {PAIRS} SELECT scan_id, query_id, point_id, d2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, point_id) AS rk FROM pr WHERE d2<=0.25) WHERE rk<=5", "cloud")
def radius_join_nearest(spark, sf):
    c = fx.cloud(spark, sf)
    return op.ball_join(c.withColumnRenamed("point_id", "query_id"), c, 0.5, 5)


@case("D2_knn_join", f"WITH {PAIRS}, {NEAR} SELECT * FROM nn", "cloud")
def knn_join(spark, sf):
    return near8(spark, sf)


@case("D2_knn_join_two_clouds", f"""WITH pr AS (SELECT q.scan_id, q.point_id AS query_id, s.point_id, {D2} AS d2 FROM points q JOIN cloud s ON q.scan_id=s.scan_id)
SELECT scan_id, query_id, CAST(rank AS INTEGER) AS rank, point_id, d2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, point_id) AS rank FROM pr) WHERE rank<=3""", "points cloud")
def knn_two(spark, sf):
    return op.knn_join(fx.points(spark, sf).withColumnRenamed("point_id", "query_id"), fx.cloud(spark, sf), 3)


@case("D2b_all_cells_probed", f"""WITH pr AS (SELECT q.vec_id AS query_id, s.vec_id, list_sum(list_transform(range(1,65), lambda i: (CAST(q.embedding[i] AS DOUBLE)-CAST(s.embedding[i] AS DOUBLE))*(CAST(q.embedding[i] AS DOUBLE)-CAST(s.embedding[i] AS DOUBLE)))) AS d2 FROM embeddings q, embeddings s)
SELECT CAST(0 AS INTEGER) AS scan_id, query_id, vec_id, CAST(rk AS INTEGER) AS rank, {six('d2')} AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) AS rk FROM pr) WHERE rk<=5""")
def approximate_knn_exact(spark, sf):
    """With as many probes as cells the search is exact."""
    e = fx.read(spark, sf, "embeddings").withColumn("scan_id", F.lit(0))
    return op.approximate_knn(e.withColumnRenamed("vec_id", "query_id"), e, 5, probes=12, cells=12, s_id="vec_id", vector="embedding").withColumn("d2", six_digits("d2"))


@case("D2b_approximate_knn")
def approximate_knn(spark, sf):
    e = fx.read(spark, sf, "embeddings").withColumn("scan_id", F.lit(0))
    return op.approximate_knn(e.withColumnRenamed("vec_id", "query_id"), e, 5, probes=8, s_id="vec_id", vector="embedding")


@case("D3_dilated_knn", f"""WITH {PAIRS}, {NEAR}, w AS (SELECT query_id, max(rank) AS n FROM nn GROUP BY 1),
p AS (SELECT w.query_id, pick, n FROM w, range(0,4) t(pick))
SELECT nn.scan_id, nn.query_id, CAST(pick AS INTEGER) AS pick, nn.point_id, nn.d2 FROM p JOIN nn ON nn.query_id=p.query_id
 AND nn.rank={fx.h('dil', 'nn.scan_id', 'p.query_id', 'pick')}%p.n+1""", "cloud")
def dilated_knn(spark, sf):
    c = fx.cloud(spark, sf)
    return op.dilated_knn(c.withColumnRenamed("point_id", "query_id"), c, 4, 2, "dil")


@case("D4_knn_interpolate", f"""WITH pr AS (SELECT q.scan_id, q.point_id AS query_id, s.point_id, s.label, {D2} AS d2 FROM points q JOIN cloud s ON q.scan_id=s.scan_id),
nn AS (SELECT *, 1/greatest(d2, CAST(1e-16 AS DOUBLE)) AS w FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, point_id) AS rank FROM pr) WHERE rank<=3)
SELECT scan_id, query_id, {six('sum(w*label)/sum(w)')} AS value FROM nn GROUP BY 1,2""", "points cloud")
def knn_interpolate(spark, sf):
    out = op.knn_interpolate(fx.cloud(spark, sf), fx.points(spark, sf).withColumnRenamed("point_id", "query_id"), 3, ["label"])
    return out.select("scan_id", "query_id", six_digits("label").alias("value"))


@case("D5_neighbour_histogram", f"""WITH {PAIRS}, c AS (SELECT query_id, count(*) FILTER (d2<=0.0625) AS n1, count(*) FILTER (d2<=0.25) AS n2 FROM pr GROUP BY 1)
SELECT CAST(0.25 AS DOUBLE) AS radius, n1 AS n, count(*) AS queries FROM c GROUP BY 2 UNION ALL SELECT CAST(0.5 AS DOUBLE), n2, count(*) FROM c GROUP BY 2""", "cloud")
def neighbour_histogram(spark, sf):
    c = fx.cloud(spark, sf)
    return op.neighbour_histogram(c.withColumnRenamed("point_id", "query_id"), c, [0.25, 0.5])


def _huber(d):
    return f"CASE WHEN {d}<0.25 THEN 0.5*{d}*{d} ELSE 0.25*({d}-0.125) END"


def _sides(kind, dist):
    def way(q, s, side):
        return f"""SELECT q.scan_id, '{kind}' AS kind, '{side}' AS side, q.point_id, arg_min(s.point_id, row({dist}, s.point_id)) AS other, min({dist}) AS dist
 FROM {q} q JOIN {s} s ON q.scan_id=s.scan_id GROUP BY 1,2,3,4"""
    return way("points", "cloud", "a") + " UNION ALL " + way("cloud", "points", "b")


L1 = "(abs(q.x-s.x)+abs(q.y-s.y)+abs(q.z-s.z))"
HUBER = "(" + "+".join(_huber(f"abs(q.{a}-s.{a})") for a in "xyz") + ")"


@case("D6_nearest_distance", _sides("squared", D2) + " UNION ALL " + _sides("l1", L1) + " UNION ALL " + _sides("huber", HUBER), "points cloud")
def nearest_distance(spark, sf):
    a, b = fx.points(spark, sf), fx.cloud(spark, sf)
    euclid = op.nearest_both(a, b)
    out = [op.nearest_distance(a, b, kind, delta=0.25, euclid=euclid).withColumn("kind", F.lit(kind)) for kind in ("squared", "l1", "huber")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@case("D7_field_energy", f"""SELECT q.scan_id, {six('sum((q.label-s.label)*(q.label-s.label))/max(n)/2')} AS energy FROM cloud q JOIN cloud s ON q.scan_id=s.scan_id
 JOIN (SELECT scan_id, count(*) AS n FROM cloud GROUP BY 1) c ON c.scan_id=q.scan_id WHERE {D2}<=0.0625 GROUP BY 1""", "cloud")
def field_energy(spark, sf):
    return op.dirichlet_energy(fx.cloud(spark, sf), 0.25, "label").withColumn("energy", six_digits("energy"))


def _level(below, size):
    return f"SELECT scan_id, max(point_id) AS point_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM {below} GROUP BY scan_id, {', '.join(f'round_even({a}/{size},0)' for a in 'xyz')}"


def _ranked(q, s, k):
    return f"SELECT * FROM (SELECT q.scan_id, q.point_id AS query_id, s.point_id, {D2} AS d2, row_number() OVER (PARTITION BY q.scan_id, q.point_id ORDER BY {D2}, s.point_id) AS rk FROM {q} q JOIN {s} s ON q.scan_id=s.scan_id) WHERE rk<={k}"


def _pyramid(level, below, here):
    w = "1/greatest(d2, CAST(1e-16 AS DOUBLE))"
    return f"""SELECT scan_id, {level} AS level, 'neighbour' AS kind, query_id, point_id, {six('d2')} AS value FROM ({_ranked(here, below, 4)})
UNION ALL SELECT scan_id, {level}, 'weight', query_id, point_id, {six(f'{w}/sum({w}) OVER (PARTITION BY scan_id, query_id)')} FROM ({_ranked(below, here, 3)})"""


@case("D8_scale_pyramid", f"WITH v1 AS MATERIALIZED ({_level('cloud', 0.5)}), v2 AS MATERIALIZED ({_level('v1', 1.0)}) {_pyramid(1, 'cloud', 'v1')} UNION ALL {_pyramid(2, 'v1', 'v2')}", "cloud")
def scale_pyramid(spark, sf):
    return op.pyramid(fx.cloud(spark, sf), [(0.5, 4), (1.0, 4)]).withColumn("value", six_digits("value"))


def _eigen_sql(source, keys):
    """Ascending eigenvalues by the trigonometric form."""
    return f"""s AS (SELECT {keys}, covar_pop(x,x) AS xx, covar_pop(x,y) AS xy, covar_pop(x,z) AS xz, covar_pop(y,y) AS yy, covar_pop(y,z) AS yz, covar_pop(z,z) AS zz FROM {source} GROUP BY ALL),
t AS (SELECT *, (xx+yy+zz)/3 AS m FROM s), t2 AS (SELECT *, sqrt(((xx-m)*(xx-m)+(yy-m)*(yy-m)+(zz-m)*(zz-m)+2*(xy*xy+xz*xz+yz*yz))/6) AS p FROM t),
t3 AS (SELECT *, CASE WHEN p=0 THEN 0 ELSE ((xx-m)*((yy-m)*(zz-m)-yz*yz)-xy*(xy*(zz-m)-yz*xz)+xz*(xy*yz-(yy-m)*xz))/(p*p*p)/2 END AS d FROM t2),
t4 AS (SELECT *, acos(greatest(-1, least(1, d)))/3 AS f FROM t3),
e AS (SELECT {keys}, greatest(0, m+2*p*cos(f+2*pi()/3)) AS l1, greatest(0, 3*m-(m+2*p*cos(f))-(m+2*p*cos(f+2*pi()/3))) AS l2, greatest(0, m+2*p*cos(f)) AS l3 FROM t4)"""


@case("E1_cloud_pca", f"WITH {_eigen_sql('cloud', 'scan_id')} SELECT scan_id, {six('l1')} AS l1, {six('l2')} AS l2, {six('l3')} AS l3 FROM e", "cloud")
def cloud_pca(spark, sf):
    return geo.cloud_pca(fx.cloud(spark, sf)).select("scan_id", *[six_digits(c).alias(c) for c in ("l1", "l2", "l3")])


HOOD = f"{PAIRS}, {NEAR}, hood AS (SELECT nn.scan_id, query_id, c.x, c.y, c.z FROM nn JOIN cloud c ON c.point_id=nn.point_id AND c.scan_id=nn.scan_id)"


@case("E2_point_pca", f"WITH {HOOD}, {_eigen_sql('hood', 'scan_id, query_id')} SELECT scan_id, query_id, {six('l1')} AS l1, {six('l2')} AS l2, {six('l3')} AS l3 FROM e", "cloud")
def point_pca(spark, sf):
    c = fx.cloud(spark, sf)
    out = geo.point_pca(c.withColumnRenamed("point_id", "query_id"), c, 8)
    return out.select("scan_id", "query_id", *[six_digits(v).alias(v) for v in ("l1", "l2", "l3")])


def _three(e):
    return f"floor(({e})*1000+CAST(0.5 AS DOUBLE))/1000"


EIG = f"""WITH l AS (SELECT p_partkey, CAST({fx.h('l1', 'p_partkey')}%64 AS DOUBLE)/64 AS l1, CAST({fx.h('l2', 'p_partkey')}%64 AS DOUBLE)/64+1 AS l2, CAST({fx.h('l3', 'p_partkey')}%64 AS DOUBLE)/64+2 AS l3 FROM part),
f AS (SELECT *, (sqrt(l3)+1e-6-sqrt(l2))/(sqrt(l3)+1e-6) AS a, (sqrt(l2)-sqrt(l1))/(sqrt(l3)+1e-6) AS b, sqrt(l1)/(sqrt(l3)+1e-6) AS c FROM l)"""


@case("E3_eigen_features", f"""{EIG} SELECT p_partkey, {six('a')} AS linearity, {six('b')} AS planarity, {six('c')} AS scattering,
 {six('exp(a/0.5)/(exp(a/0.5)+exp(b/0.5)+exp(c/0.5))')} AS soft FROM f""")
def eigen_features(spark, sf):
    l = _eigenvalues(spark, sf)
    hard = geo.eigen_features(l)
    soft = geo.eigen_features(l, 0.5).select("p_partkey", F.col("linearity").alias("soft"))
    return hard.join(soft, "p_partkey").select("p_partkey", *[six_digits(c).alias(c) for c in ("linearity", "planarity", "scattering", "soft")])


def _eigenvalues(spark, sf):
    from pointweave.functions.rand import key_hash
    v = lambda t, add: ((key_hash(t, "p_partkey") % 64).cast("double") / 64 + add).alias(t)
    return fx.read(spark, sf, "part").select("p_partkey", v("l1", 0), v("l2", 1), v("l3", 2))


@case("E4_planarity", f"{EIG} SELECT p_partkey, (l2-l1)/l3 AS planarity FROM l")
def planarity(spark, sf):
    return _eigenvalues(spark, sf).select("p_partkey", geo.planarity("l1", "l2", "l3").alias("planarity"))


@case("C24_scan_filters", f"WITH {_eigen_sql('cloud', 'instance')}, k AS (SELECT instance FROM e WHERE (l2-l1)/l3<=0.2 AND {fx.u('keep', 'instance')}<0.5) SELECT point_id, instance FROM cloud WHERE instance IN (SELECT instance FROM k)", "cloud")
def scan_filters(spark, sf):
    c = fx.cloud(spark, sf)
    flat = geo.cloud_pca(c, ["instance"]).select("instance", (geo.planarity("l1", "l2", "l3") <= 0.2).alias("keep"))
    return tables.filter_scans(c, flat, tables.random_verdict(c, 0.5, "keep", ["instance"]), by=["instance"]).select("point_id", "instance")


@case("E5_density", f"""WITH {PAIRS}, {NEAR}, d AS (SELECT scan_id, query_id, max(d2) FILTER (rank=4) AS a, max(d2) FILTER (rank=8) AS b FROM nn GROUP BY 1,2)
SELECT scan_id, query_id, CASE WHEN a IS NULL THEN 1 WHEN a=0 THEN CAST('inf' AS DOUBLE) ELSE {six('CAST(5 AS DOUBLE)/(CAST(3.1416 AS DOUBLE)*a)*CAST(0.0025 AS DOUBLE)')} END AS density_4,
 CASE WHEN b IS NULL THEN 1 WHEN b=0 THEN CAST('inf' AS DOUBLE) ELSE {six('CAST(9 AS DOUBLE)/(CAST(3.1416 AS DOUBLE)*b)*CAST(0.0025 AS DOUBLE)')} END AS density_8 FROM d""", "cloud")
def density(spark, sf):
    d = geo.point_density(near8(spark, sf), [4, 8], 0.05)
    inf = F.lit(float("inf"))
    return d.select("scan_id", "query_id", *[F.when(F.col(c) == inf, inf).otherwise(six_digits(c)).alias(c) for c in ("density_4", "density_8")])


@case("E6_occlusion", f"""WITH pr AS (SELECT q.scan_id, q.point_id AS query_id, s.point_id, {D2} AS d2 FROM points q JOIN points s ON q.scan_id=s.scan_id), {NEAR}
SELECT v.scan_id, v.image_id, v.point_id, (1+count(w.point_id) FILTER (rank<=4))/CAST(5 AS DOUBLE) AS occlusion_4, (1+count(w.point_id))/CAST(9 AS DOUBLE) AS occlusion_8
FROM views v JOIN nn ON nn.query_id=v.point_id AND nn.scan_id=v.scan_id LEFT JOIN views w ON w.scan_id=v.scan_id AND w.image_id=v.image_id AND w.point_id=nn.point_id
GROUP BY 1,2,3""", "points views")
def occlusion(spark, sf):
    p = fx.points(spark, sf)
    near = op.knn_join(p.withColumnRenamed("point_id", "query_id"), p, 8)
    return geo.view_occlusion(fx.views(spark, sf), near, [4, 8])
