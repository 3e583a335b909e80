"""The catalogue of point queries over quantised embeddings and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import curve, points as P
from ..operators import balance, classify, groups, knn, order, pairs, runs, stats
from ..runtime import Stages, table
from ..streaming.quantile import batch_quantile, shuffled_quantile
from .sqlgen import curve_key_sql, wide_key_sql

#: Dimensions of the points, bits, neighbours and window; narrow keys (below 64 bits) are taken over the first NARROW dimensions.
DIMS, NARROW, BITS, K, WINDOW = 64, 6, 10, 5, 20
PERM = [(7 * i + 3) % 64 for i in range(64)]


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id is not null and embedding is not null").select(F.col("vec_id").alias("id"), P.quantize(F.col("embedding")).alias("coords"), "label")


def asked(points: DataFrame) -> DataFrame:
    """The stated query set: ids divisible by 20."""
    return points.where("id % 20 = 0")


def _text(c):
    return F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Stages(spark, "index").write(order.curve_index(pts(spark, sf_dir), DIMS, BITS))


QUERIES, SQL = {}, {}
_PTS = "pts AS (SELECT vec_id AS id, list_transform(embedding, lambda x: least(1023, greatest(0, floor((x::DOUBLE + 1) * 512)))::INT) AS coords, label FROM embeddings)"
_D2 = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2])::BIGINT * (z[1] - z[2])))::BIGINT"
_NARROW = "k AS (" + curve_key_sql("pts", [f"coords[{i + 1}]" for i in range(NARROW)], BITS, "id") + ")"
_KEYS = "k AS (" + wide_key_sql("pts", "coords", BITS, "id") + ")"
_IDX = f"{_PTS}, {_KEYS}, idx AS (SELECT p.id, p.coords, p.label, k.hkey, row_number() OVER (ORDER BY k.hkey, p.id) - 1 AS pos FROM pts p JOIN k USING (id))"
_CNT = f"cnt AS (SELECT label, count(*) AS n FROM pts GROUP BY label)"
_EXACT = f"ex AS (SELECT * FROM (SELECT q.id AS q, p.id, {_D2.format('q.coords', 'p.coords')} AS d2, q.coords AS qc FROM pts q JOIN pts p ON q.id <> p.id WHERE q.id % 20 = 0) QUALIFY row_number() OVER (PARTITION BY q ORDER BY d2, id) <= {K})"
_CEN = "cen AS (SELECT label, list(x ORDER BY dim) AS centroid, any_value(n) AS n FROM (SELECT label, dim, round_even(avg(x), 0)::INT AS x, count(*) AS n FROM (SELECT label, unnest(coords) AS x, unnest(range(len(coords))) AS dim FROM pts) GROUP BY label, dim) GROUP BY label)"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


@query("quantize_points", f"WITH {_PTS} SELECT id, array_to_string(coords, ',') AS coords FROM pts")
def quantize_points(spark, d):
    return pts(spark, d).select("id", _text("coords").alias("coords"))


@query("point_invariants", f"WITH {_PTS} SELECT id, list_sum(list_transform(coords, lambda x: x::BIGINT * x))::BIGINT AS mag2, list_max(coords) AS max_coord, label FROM pts")
def point_invariants(spark, d):
    return pts(spark, d).select("id", P.square_magnitude(F.col("coords")).alias("mag2"), F.array_max("coords").alias("max_coord"), "label")


@query("bits_needed", f"WITH {_PTS} SELECT label, CASE WHEN max(list_max(coords)) > 0 THEN length(bin(max(list_max(coords)))) ELSE 0 END::INT AS bits FROM pts GROUP BY label")
def bits(spark, d):
    return pts(spark, d).groupBy("label").agg(curve.bits_needed(F.max(F.array_max("coords")) + 1).alias("bits"))


@query("hilbert_index_2d", f"WITH {_PTS} " + curve_key_sql("pts", ["coords[1]", "coords[2]"], BITS, "id"))
def hilbert_index_2d(spark, d):
    return order.with_key(pts(spark, d), 2, BITS).select("id", "hkey")


@query("hilbert_index_64d", f"WITH {_PTS}, {_KEYS} SELECT id, hkey FROM k")
def hilbert_index_64d(spark, d):
    return order.with_key(pts(spark, d), DIMS, BITS).select("id", F.hex("hkey").alias("hkey"))


@query("hilbert_index_6d", f"WITH {_PTS}, {_NARROW} SELECT id, hkey FROM k")
def hilbert_index_6d(spark, d):
    return order.with_key(pts(spark, d), NARROW, BITS).select("id", "hkey")


@query("hilbert_inverse", f"WITH {_PTS} SELECT id, array_to_string(coords[1:{NARROW}], ',') AS coords FROM pts")
def hilbert_inverse(spark, d):
    return order.with_key(pts(spark, d), NARROW, BITS).select("id", _text(curve.curve_point(F.col("hkey"), NARROW, BITS)).alias("coords"))


@query("hilbert_wide_inverse", f"WITH {_PTS} SELECT id, array_to_string(coords, ',') AS coords, 80 AS key_bytes FROM pts")
def hilbert_wide_inverse(spark, d):
    """All 64 dimensions at 10 bits: binary keys of 80 bytes."""
    k = order.with_key(pts(spark, d), 64, BITS)
    return k.select("id", _text(curve.curve_point(F.col("hkey"), 64, BITS)).alias("coords"), F.octet_length("hkey").alias("key_bytes"))


@query("hilbert_prefix_buckets", f"WITH {_PTS}, {_NARROW} SELECT hkey >> {NARROW * 8} AS prefix, count(*) AS n, min(id) AS first_id FROM k GROUP BY 1")
def hilbert_prefix_buckets(spark, d):
    return order.tied_groups(order.with_key(pts(spark, d), NARROW, BITS), NARROW, BITS, 2)


_ITEM_COLS = ["l_quantity::INT", "round(l_discount * 100)::INT", "round(l_tax * 100)::INT", "l_linenumber"]


@query(
    "hilbert_lineitem_cells",
    "WITH u AS (SELECT l_quantity, l_discount, l_tax, l_linenumber, l_extendedprice FROM lineitem), k AS (" + curve_key_sql("u", _ITEM_COLS, 6, "l_extendedprice") + ") SELECT hkey >> 12 AS cell, count(*) AS n, min(hkey) AS low, max(hkey) AS high, round(sum(l_extendedprice), 2) AS price FROM k GROUP BY 1",
)
def hilbert_lineitem_cells(spark, d):
    """Low-dimensional, many rows: line items as points of 4 dimensions, counted by coarse curve cell."""
    li = table(spark, d, "lineitem").select(F.array(F.col("l_quantity").cast("int"), F.round(F.col("l_discount") * 100).cast("int"), F.round(F.col("l_tax") * 100).cast("int"), F.col("l_linenumber").cast("int")).alias("coords"), "l_extendedprice")
    # few distinct points: keys are computed once per point, after a partial aggregation
    few = li.groupBy("coords").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("price"))
    k = order.with_key(few, 4, 6)
    return k.groupBy(F.shiftright("hkey", 12).alias("cell")).agg(F.sum("n").alias("n"), F.min("hkey").alias("low"), F.max("hkey").alias("high"), F.round(F.sum("price"), 2).alias("price"))


@query("permute_points", f"WITH {_PTS} SELECT id, array_to_string(list_transform({[p + 1 for p in PERM]}, lambda j: coords[j]), ',') AS coords FROM pts")
def permute_points(spark, d):
    return pts(spark, d).select("id", _text(P.permute(F.col("coords"), PERM)).alias("coords"))


@query("sq_distance_pairs", f"WITH {_PTS} SELECT a.id, {_D2.format('a.coords', 'b.coords')} AS d2, sqrt({_D2.format('a.coords', 'b.coords')}::DOUBLE) AS d FROM pts a JOIN pts b ON b.id = a.id + 1")
def sq_distance_pairs(spark, d):
    p = pts(spark, d)
    b = p.select((F.col("id") - 1).alias("id"), F.col("coords").alias("c2"))
    d2 = P.square_distance(F.col("coords"), F.col("c2"))
    return p.join(b, "id").select("id", d2.alias("d2"), F.sqrt(d2.cast("double")).alias("d"))


@query("distance_within", f"WITH {_PTS} SELECT a.id, {_D2.format('a.coords', 'b.coords')} <= 400000 AS near FROM pts a JOIN pts b ON b.id = a.id + 1")
def distance_within(spark, d):
    p = pts(spark, d).withColumn("m", P.square_magnitude(F.col("coords")))
    b = p.select((F.col("id") - 1).alias("id"), F.col("coords").alias("c2"), F.col("m").alias("m2"))
    return p.join(b, "id").select("id", P.within(F.col("coords"), F.col("c2"), F.col("m"), F.col("m2"), F.lit(400_000)).alias("near"))


@query("hilbert_sort", f"WITH {_IDX} SELECT id, pos FROM idx")
def hilbert_sort(spark, d):
    return index(spark, d).select("id", "pos")


@query("hilbert_positions", f"WITH {_IDX} SELECT id, hkey, pos, row_number() OVER (ORDER BY id) - 1 AS original FROM idx")
def hilbert_positions(spark, d):
    return order.global_positions(index(spark, d), ["id"], "original").select("id", F.hex("hkey").alias("hkey"), "pos", "original")


@query("sort_like", f"WITH {_IDX} SELECT e.vec_id AS id, e.label, pos FROM embeddings e JOIN idx ON e.vec_id = idx.id")
def sort_like(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return order.sort_like(rows, index(spark, d), "id", "pos").select("id", "label", "pos")


def _reference(p):
    return p.crossJoin(F.broadcast(p.orderBy("id").limit(1).select(F.col("coords").alias("r"))))  # one row


@query("topk_nearest", f"WITH {_PTS}, r AS (SELECT coords FROM pts ORDER BY id LIMIT 1) SELECT id, {_D2.format('pts.coords', 'r.coords')} AS d2 FROM pts, r ORDER BY d2, id LIMIT 10")
def topk_nearest(spark, d):
    return order.top_by_distance(_reference(pts(spark, d)), P.square_distance(F.col("coords"), F.col("r")), 10).select("id", "d2")


@query("topk_farthest", f"WITH {_PTS}, r AS (SELECT coords FROM pts ORDER BY id LIMIT 1) SELECT id, {_D2.format('pts.coords', 'r.coords')} AS d2 FROM pts, r ORDER BY d2 DESC, id LIMIT 10")
def topk_farthest(spark, d):
    return order.top_by_distance(_reference(pts(spark, d)), P.square_distance(F.col("coords"), F.col("r")), 10, farthest=True).select("id", "d2")


@query("curve_range", f"WITH {_IDX}, n AS (SELECT count(*) AS n FROM idx) SELECT q.id AS q, p.id, p.pos AS at FROM idx q, n, idx p WHERE q.id % 20 = 0 AND p.pos BETWEEN greatest(0, least(q.pos - 5, n - 10)) AND least(greatest(0, least(q.pos - 5, n - 10)) + 10, n) - 1")
def curve_range(spark, d):
    i = index(spark, d)
    return knn.curve_range(i, asked(i), 10)


_CKNN = f"ck AS (SELECT q.id AS q, p.id, {_D2.format('q.coords', 'p.coords')} AS d2 FROM idx q JOIN idx p ON p.pos BETWEEN q.pos - {WINDOW} AND q.pos + {WINDOW} AND p.id <> q.id WHERE q.id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY {_D2.format('q.coords', 'p.coords')}, p.id) <= {K})"


@query("curve_knn", f"WITH {_IDX}, {_CKNN} SELECT q, id, d2 FROM ck")
def curve_knn(spark, d):
    i = index(spark, d)
    return knn.curve_knn(i, asked(i), K, WINDOW).select("q", "id", "d2")


@query("exact_knn", f"WITH {_PTS}, {_EXACT} SELECT q, id, d2 FROM ex")
def exact_knn(spark, d):
    p = pts(spark, d)
    return knn.exact_knn(p, asked(p), K).select("q", "id", "d2")


@query("knn_accuracy", f"WITH {_IDX}, {_CKNN}, {_EXACT} SELECT ex.q, count(ck.id) AS hits, count(ck.id) / {K}.0::DOUBLE AS accuracy FROM ex LEFT JOIN ck ON ck.q = ex.q AND ck.id = ex.id GROUP BY ex.q")
def knn_accuracy(spark, d):
    i = index(spark, d)
    return knn.accuracy(knn.curve_knn(i, asked(i), K, WINDOW), knn.exact_knn(i, asked(i), K), K)


_KEYS2 = "k2 AS (" + wide_key_sql("pts", "list_reverse(coords)", BITS, "id") + "), idx2 AS (SELECT p.id, p.coords, row_number() OVER (ORDER BY k2.hkey, p.id) - 1 AS pos FROM pts p JOIN k2 USING (id))"


@query("composite_accuracy", f"WITH {_IDX}, {_KEYS2}, {_CKNN}, {_CKNN.replace('ck AS', 'ck2 AS').replace('idx', 'idx2')}, {_EXACT}, u AS (SELECT q, id FROM ck UNION SELECT q, id FROM ck2) SELECT ex.q, count(u.id) AS hits, count(u.id) / {K}.0::DOUBLE AS accuracy FROM ex LEFT JOIN u ON u.q = ex.q AND u.id = ex.id GROUP BY ex.q")
def composite_accuracy(spark, d):
    """Union of the windows of two curves: over the dimensions in their order and reversed."""
    p = pts(spark, d)
    i = index(spark, d)
    back = order.with_key(p.withColumn("c", F.reverse("coords")), DIMS, BITS, "c").drop("c")
    j = Stages(spark, "index").write(order.global_positions(back, ["hkey", "id"]))
    both = knn.curve_knn(i, asked(i), K, WINDOW).unionByName(knn.curve_knn(j, asked(j), K, WINDOW))
    return knn.accuracy(both, knn.exact_knn(p, asked(p), K), K)


@query("closest_pair_exact", f"WITH {_PTS} SELECT a.id AS id1, b.id AS id2, {_D2.format('a.coords', 'b.coords')} AS d2 FROM pts a JOIN pts b ON a.label = 0 AND b.label = 1 ORDER BY d2, id1, id2 LIMIT 1")
def closest_pair_exact(spark, d):
    return pairs.closest_pair(pts(spark, d), 0, 1)


@query("closest_pair_centroid", f"WITH {_PTS}, {_CEN}, c1 AS (SELECT centroid FROM cen WHERE label = 0), p2 AS (SELECT id AS id2, coords AS c2 FROM pts, c1 WHERE label = 1 ORDER BY {_D2.format('coords', 'centroid')}, id LIMIT 1) SELECT id AS id1, id2, {_D2.format('coords', 'c2')} AS d2 FROM pts, p2 WHERE label = 0 ORDER BY d2, id LIMIT 1")
def closest_pair_centroid(spark, d):
    return pairs.closest_pair_by_centroid(pts(spark, d), 0, 1)


@query("closest_other_cluster", f"WITH {_PTS} SELECT b.label, a.id AS id1, b.id AS id2, {_D2.format('a.coords', 'b.coords')} AS d2 FROM pts a JOIN pts b ON a.label = 0 AND b.label <> 0 ORDER BY d2, id1, id2 LIMIT 1")
def closest_other_cluster(spark, d):
    return pairs.closest_other_cluster(pts(spark, d), 0)


_NEAR = f"""{_PTS}, {_CEN}, lim AS (SELECT ceil(avg(n))::BIGINT AS m FROM cen), cp AS (SELECT x.label AS p, y.label AS q, x.n AS np, y.n AS nq, {_D2.format('x.centroid', 'y.centroid')} AS d2 FROM cen x JOIN cen y ON x.label <> y.label),
ca AS (SELECT p, q, d2 FROM cp WHERE np >= 5 AND nq >= 5 QUALIFY row_number() OVER (PARTITION BY p ORDER BY d2, q) <= 3),
co AS (SELECT p, q, d2 FROM cp, lim WHERE (np < m) <> (nq < m) QUALIFY row_number() OVER (PARTITION BY p ORDER BY d2, q) <= 3)"""
_MEET = "SELECT a, b, id1, id2, d2 FROM (SELECT pr.a, pr.b, x.id AS id1, y.id AS id2, {d2} AS d2 FROM (SELECT DISTINCT least(p, q) AS a, greatest(p, q) AS b FROM {of}) pr JOIN pts x ON x.label = pr.a JOIN pts y ON y.label = pr.b) {limit} QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY d2, id1, id2) = 1"


@query("closest_clusters_candidates", f"WITH {_NEAR} SELECT DISTINCT least(p, q)::BIGINT AS a, greatest(p, q)::BIGINT AS b, d2 FROM ca")
def closest_clusters_candidates(spark, d):
    return pairs.cluster_candidates(pts(spark, d), 5, 3)


@query("closest_clusters", f"WITH {_NEAR} SELECT a::BIGINT AS a, b::BIGINT AS b, id1, id2, d2 FROM (" + _MEET.format(d2=_D2.format("x.coords", "y.coords"), of="ca", limit="WHERE d2 <= 500000") + ")")
def closest_clusters(spark, d):
    """Closest points of neighbouring clusters of at least five points, at most 500,000 apart."""
    return pairs.closest_clusters(pts(spark, d), 3, 500_000, 5)


@query("closest_outliers", f"WITH {_NEAR} SELECT a::BIGINT AS a, b::BIGINT AS b, id1, id2, d2 FROM (" + _MEET.format(d2=_D2.format("x.coords", "y.coords"), of="co", limit="") + ")")
def closest_outliers(spark, d):
    """Closest points of clusters below the mean size and neighbouring ones that aren't."""
    p = pts(spark, d)
    least = p.groupBy("label").count().agg(F.ceil(F.avg("count"))).first()[0]
    return pairs.closest_outliers(p, 3, None, int(least or 1))


@query(
    "curve_nearest",
    f"""WITH {_IDX}, g AS (SELECT *, count(*) FILTER (label = 0) OVER (ORDER BY pos) AS g FROM idx WHERE label IS NOT NULL),
o AS (SELECT id AS id1, coords AS c1, g FROM g WHERE label = 0),
f AS (SELECT label, g, id, coords, row_number() OVER (PARTITION BY label, g ORDER BY pos) AS first, row_number() OVER (PARTITION BY label, g ORDER BY pos DESC) AS last FROM g WHERE label <> 0),
m AS (SELECT f.label, id1, f.id AS id2, {_D2.format('c1', 'f.coords')} AS d2 FROM f JOIN o ON (f.first = 1 AND o.g = f.g) OR (f.last = 1 AND o.g = f.g + 1))
SELECT label, id1, id2, d2 FROM m QUALIFY row_number() OVER (PARTITION BY label ORDER BY d2, id1, id2) = 1""",
)
def curve_nearest(spark, d):
    """For each cluster its nearest meeting with cluster 0 along the curve."""
    return pairs.curve_nearest(index(spark, d), 0)


@query("curve_closest_pair", f"WITH {_IDX}, t AS (SELECT id, label, coords, row_number() OVER (ORDER BY pos) AS at FROM idx WHERE label IN (0, 1)) SELECT least(a.id, b.id) AS id1, greatest(a.id, b.id) AS id2, {_D2.format('a.coords', 'b.coords')} AS d2 FROM t a JOIN t b ON b.at = a.at + 1 AND a.label <> b.label ORDER BY d2, id1, id2 LIMIT 1")
def curve_closest_pair(spark, d):
    return pairs.curve_closest_pair(index(spark, d), 0, 1)


@query("cluster_centroids", f"WITH {_PTS}, {_CEN} SELECT label, array_to_string(centroid, ',') AS centroid, n FROM cen")
def cluster_centroids(spark, d):
    return stats.centroids(pts(spark, d)).select("label", _text("centroid").alias("centroid"), "n")


_DIST = f"sqrt({_D2.format('p.coords', 'c.centroid')}::DOUBLE)"


@query("cluster_radius", f"WITH {_PTS}, {_CEN} SELECT p.label, count(*) AS n, round(max({_DIST}), 6) AS max_radius, round(avg({_DIST}), 6) AS mean_radius FROM pts p JOIN cen c USING (label) GROUP BY p.label")
def cluster_radius(spark, d):
    return stats.radii(pts(spark, d)).select("label", "n", F.round("max_radius", 6).alias("max_radius"), F.round("mean_radius", 6).alias("mean_radius"))


_RAD = f"SELECT {{k}}, 2 * max(sqrt({_D2.format('coords', 'centroid')}::DOUBLE)) + avg(sqrt({_D2.format('coords', 'centroid')}::DOUBLE)) AS w FROM {{f}} GROUP BY {{k}}"


@query(
    "cluster_shrinkage",
    f"""WITH {_PTS}, {_CEN}, r AS ({_RAD.format(k='label', f='pts JOIN cen USING (label)')}),
pr AS (SELECT a.label AS a, b.label AS b FROM (SELECT DISTINCT label FROM pts) a JOIN (SELECT DISTINCT label FROM pts) b ON b.label = a.label + 1),
u AS (SELECT pr.a, pr.b, p.coords FROM pr JOIN pts p ON p.label = pr.a OR p.label = pr.b),
uc AS (SELECT a, b, list(x ORDER BY dim) AS centroid FROM (SELECT a, b, dim, round_even(avg(x), 0)::INT AS x FROM (SELECT a, b, unnest(coords) AS x, unnest(range(len(coords))) AS dim FROM u) GROUP BY a, b, dim) GROUP BY a, b),
ur AS ({_RAD.format(k='a, b', f='u JOIN uc USING (a, b)')})
SELECT ur.a, ur.b, round(ur.w / (x.w + y.w), 6) AS shrinkage FROM ur JOIN r x ON x.label = ur.a JOIN r y ON y.label = ur.b""",
)
def cluster_shrinkage(spark, d):
    p = pts(spark, d)
    two = p.select("label").distinct().select(F.col("label").alias("a"), (F.col("label") + 1).alias("b")).join(p.select(F.col("label").alias("b")).distinct(), "b")
    return stats.shrinkage(p, two).select("a", "b", F.round("shrinkage", 6).alias("shrinkage"))


@query("partition_counts", f"WITH {_PTS}, {_CNT} SELECT count(*) AS clusters, count(*) FILTER (n >= 40) AS large, min(n) FILTER (n >= 40) AS smallest_large, sum(n)::BIGINT AS points, round((sum(n) * sum(n))::DOUBLE / sum(n * n)::DOUBLE, 6) AS effective FROM cnt")
def partition_counts(spark, d):
    return stats.partition_counts(pts(spark, d), 40).withColumn("effective", F.round("effective", 6))


def _buckets(spark, d):
    """A second grouping of the same points: id modulo 7."""
    return pts(spark, d).select("id", (F.col("id") % 7).alias("label"))


_CONT = f"{_PTS}, cont AS (SELECT label AS gold, id % 7 AS label, count(*) AS n FROM pts WHERE label IS NOT NULL GROUP BY ALL)"


@query("bcubed", f"WITH {_CONT}, w AS (SELECT n, sum(n) OVER (PARTITION BY label) AS c, sum(n) OVER (PARTITION BY gold) AS g FROM cont), r AS (SELECT sum(n * n / c::DOUBLE) / sum(n) AS precision, sum(n * n / g::DOUBLE) / sum(n) AS recall FROM w) SELECT round(precision, 9) AS precision, round(recall, 9) AS recall, round(1 / (0.5 / precision + 0.5 / recall), 9) AS f FROM r")
def bcubed(spark, d):
    return stats.b_cubed(pts(spark, d), _buckets(spark, d)).select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f")])


_MAJ = f"{_CONT}, maj AS (SELECT label, gold, n, count(*) OVER (PARTITION BY label) AS kinds FROM cont QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, gold) = 1)"


@query("concordance", f"WITH {_MAJ} SELECT label, gold, n, kinds FROM maj")
def concordance(spark, d):
    return stats.majority(pts(spark, d), _buckets(spark, d)).select("label", "gold", "n", "kinds")


@query("homogeneity", f"WITH {_CONT} SELECT label, count(DISTINCT gold) AS kinds FROM cont GROUP BY label")
def homogeneity(spark, d):
    return stats.contingency(pts(spark, d), _buckets(spark, d)).groupBy("label").agg(F.countDistinct("gold").alias("kinds"))


@query("misplaced", f"WITH {_MAJ} SELECT p.id, p.id % 7 AS label FROM pts p JOIN maj ON maj.label = p.id % 7 WHERE p.label <> maj.gold")
def misplaced(spark, d):
    return stats.misplaced(pts(spark, d), _buckets(spark, d))


@query("concord", f"WITH {_IDX}, s AS (SELECT count(*) FILTER (l IS NULL OR l <> label) AS segments, count(DISTINCT label) AS partitions FROM (SELECT label, lag(label) OVER (ORDER BY pos) AS l FROM idx)) SELECT partitions, segments, partitions / segments::DOUBLE AS concord FROM s")
def concord(spark, d):
    return stats.transitions(index(spark, d).select("pos", "label"))


@query("identical_clusters", f"WITH {_PTS}, o AS (SELECT id, CASE WHEN label % 2 = 0 THEN label * 3 ELSE id % 5 END AS other FROM pts), a AS (SELECT label, list(id ORDER BY id) AS m FROM pts GROUP BY label), b AS (SELECT other, list(id ORDER BY id) AS m FROM o GROUP BY other) SELECT label, other FROM a JOIN b USING (m)")
def identical_clusters(spark, d):
    p = pts(spark, d)
    other = p.select("id", F.expr("case when label % 2 = 0 then label * 3 else id % 5 end").alias("label"))
    return stats.identical_clusters(p, other)


_DIM = "dims AS (SELECT dim, min(x) AS low, max(x) AS high, quantile_disc(x, 0.5)::BIGINT AS median FROM (SELECT unnest(coords) AS x, unnest(range(len(coords))) AS dim FROM pts) GROUP BY dim), dims2 AS (SELECT dim::INT AS dim, low, high, median, (SELECT CASE WHEN max(high) > 0 THEN length(bin(max(high))) ELSE 0 END FROM dims)::INT AS bits FROM dims), bal AS (SELECT *, least(greatest((1::BIGINT << (bits - 1)) - median, -low), (1::BIGINT << bits) - 1 - high)::BIGINT AS shift FROM dims2)"


@query("dim_stats", f"WITH {_PTS}, {_DIM} SELECT dim, low, high, median, bits, shift FROM bal")
def dim_stats(spark, d):
    return balance.dimension_stats(pts(spark, d))


_BAL = f"{_PTS}, {_DIM}, sh AS (SELECT list(shift ORDER BY dim) AS shifts, max(bits) AS bits FROM bal), bp AS (SELECT id, list_transform(list_zip(coords, shifts), lambda z: z[1] + z[2]) AS coords, bits FROM pts, sh)"


@query("balance_points", f"WITH {_BAL} SELECT id, array_to_string(list_transform(coords, lambda x: (x >> (bits - 4))::INT), ',') AS coords FROM bp")
def balance_points(spark, d):
    return balance.balance(pts(spark, d), 4).select("id", _text("coords").alias("coords"))


@query(
    "tendency",
    f"""WITH {_BAL}, cells AS (SELECT list_transform(coords, lambda x: x >> (bits - 1)) AS c, count(*) AS n FROM bp GROUP BY 1),
r AS (SELECT count(*) AS cells, count(*) FILTER (n >= 2) AS clusters, coalesce(sum(n) FILTER (n < 2), 0)::BIGINT AS outliers, coalesce(sum(n) FILTER (n >= 2), 0)::BIGINT AS clustered, max(n) AS largest, sum(n)::BIGINT AS points FROM cells)
SELECT *, CASE WHEN clusters = 0 OR 100.0 * outliers / points >= 95 THEN 'unclustered' WHEN clusters = 1 THEN 'singly clustered' WHEN 100.0 * largest / clustered > 66.666 THEN 'majority clustered'
 WHEN 100.0 * outliers / points > 66.666 THEN 'weakly clustered' WHEN 100.0 * outliers / points > 33.333 THEN 'moderately clustered' ELSE 'highly clustered' END AS verdict FROM r""",
)
def tendency(spark, d):
    return balance.tendency(pts(spark, d), 2)


_GRID = f"{_PTS}, bt AS (SELECT unnest(range({BITS}))::INT AS bit), cells AS (SELECT bit, list_transform(coords, lambda x: x >> ({BITS} - bit)) AS a, count(*) AS n FROM pts, bt GROUP BY ALL), coarse AS (SELECT bit, sum(n * (n - 1))::DOUBLE / (sum(n) * (sum(n) - 1))::DOUBLE AS coarseness FROM cells GROUP BY bit)"


@query("grid_coarseness", f"WITH {_GRID} SELECT bit, round(coarseness, 9) AS coarseness FROM coarse")
def grid_coarseness(spark, d):
    return stats.grid_coarseness(pts(spark, d), DIMS, BITS).select("bit", F.round("coarseness", 9).alias("coarseness"))


@query("bits_to_divide", f"WITH {_GRID} SELECT coalesce(min(bit), {BITS})::INT AS bit FROM coarse WHERE coarseness <= 5.0 / (SELECT count(*) FROM pts)")
def bits_to_divide(spark, d):
    p = pts(spark, d)
    return stats.bits_to_divide(stats.grid_coarseness(p, DIMS, BITS), p.count(), 5.0, BITS)


_GAPS = f"{_IDX}, gaps AS (SELECT b.pos, b.id, {_D2.format('b.coords', 'a.coords')} AS d2 FROM idx a JOIN idx b ON b.pos = a.pos + 1)"


@query("neighbor_distance", f"WITH {_GAPS} SELECT pos, id, d2 FROM gaps")
def neighbor_distance(spark, d):
    return runs.neighbor_distances(index(spark, d))


_SKIP = 10
_CHAR = f"""{_GAPS}, so AS (SELECT d2, row_number() OVER (ORDER BY d2, pos) - 1 AS i FROM gaps), n AS (SELECT count(*) + 1 AS n FROM gaps),
st AS (SELECT i, d2, lag(d2, {_SKIP + 1}) OVER (ORDER BY i) AS p FROM so),
ra AS (SELECT i, d2, d2 - p AS inc, CASE WHEN p > 1 AND i > 10 THEN d2 / p::DOUBLE END AS ratio FROM st),
rm AS (SELECT *, coalesce(max(ratio) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM ra),
br AS (SELECT min(i) AS b FROM rm, n WHERE ratio > m AND ratio > 5 AND i > n // 2),
ke AS (SELECT * FROM ra, br WHERE b IS NULL OR i <= b),
ii AS (SELECT coalesce((SELECT i FROM ke WHERE inc > 0 ORDER BY inc DESC, i LIMIT 1), 0) AS ii, coalesce((SELECT i FROM ke WHERE ratio IS NOT NULL ORDER BY ratio DESC, i LIMIT 1), 0) AS ir),
ct AS (SELECT greatest(0, CASE WHEN ii = ir OR ir < n // 2 THEN ii ELSE ir END - {_SKIP} - 1) AS idx FROM ii, n),
ch AS (SELECT idx, a.d2 AS s, b.d2 AS median FROM ct JOIN so a ON a.i = idx JOIN so b ON b.i = idx // 2)"""


@query("characteristic_distance", f"WITH {_CHAR} SELECT idx, s, median FROM ch")
def characteristic_distance(spark, d):
    i = index(spark, d)
    return runs.characteristic_distance(runs.neighbor_distances(i), i.count(), _SKIP)


@query("cluster_count", f"WITH {_CHAR}, isl AS (SELECT idx.id, sum(CASE WHEN g.d2 > ch.s THEN 1 ELSE 0 END) OVER (ORDER BY idx.pos) AS island FROM idx LEFT JOIN gaps g ON g.pos = idx.pos, ch), sz AS (SELECT island, count(*) AS n FROM isl GROUP BY island) SELECT count(*) AS with_outliers, count(*) FILTER (n > 1) AS clusters, coalesce(sum(n) FILTER (n <= 1), 0)::BIGINT AS outlier_points FROM sz")
def cluster_count(spark, d):
    i = index(spark, d)
    g = Stages(spark, "gaps").write(runs.neighbor_distances(i))
    s = runs.characteristic_distance(g, i.count(), _SKIP).first().s
    return runs.cluster_count(runs.islands(i, g, s), 1)


_DENS = f"{_IDX}, n AS (SELECT count(*) AS n FROM idx), de AS (SELECT a.id, count(*) FILTER (a.id <> b.id AND {_D2.format('a.coords', 'b.coords')} <= 400000) AS density FROM idx a, n, idx b WHERE b.pos BETWEEN greatest(0, least(a.pos - 15, n - 31)) AND greatest(0, least(a.pos - 15, n - 31)) + 30 GROUP BY a.id)"


@query("window_density", f"WITH {_DENS} SELECT id, density FROM de")
def window_density(spark, d):
    return runs.window_density(index(spark, d), 15, 400_000)


@query("density_rank", f"WITH {_DENS} SELECT id, density, (dense_rank() OVER (ORDER BY density DESC) - 1)::INT AS rank FROM de")
def density_rank(spark, d):
    return runs.density_rank(Stages(spark, "density").write(runs.window_density(index(spark, d), 15, 400_000)))


@query("exact_density", f"WITH {_PTS} SELECT a.id AS q, count(*) FILTER ({_D2.format('a.coords', 'b.coords')} <= 400000)::BIGINT AS n FROM pts a JOIN pts b ON a.id <> b.id WHERE a.id % 20 = 0 GROUP BY a.id")
def exact_density(spark, d):
    p = pts(spark, d)
    return knn.count_within(p, asked(p), 400_000)


@query("sparse_distance", f"WITH {_PTS}, sp AS (SELECT id, list_transform(coords, lambda x: CASE WHEN abs(x - 512) > 60 THEN x ELSE 512 END) AS coords FROM pts) SELECT a.id, {_D2.format('a.coords', 'b.coords')} AS d2 FROM sp a JOIN sp b ON b.id = a.id + 1")
def sparse_distance(spark, d):
    """Sparse points (coordinates near 512 are missing)."""
    p = pts(spark, d).select("id", F.expr("map_filter(map_from_arrays(sequence(0, size(coords) - 1), coords), (d, x) -> abs(x - 512) > 60)").alias("v"))
    b = p.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    return p.join(b, "id").select("id", P.sparse_square_distance(F.col("v"), F.col("w"), F.lit(512)).alias("d2"))


@query("set_similarity", f"WITH {_PTS}, s AS (SELECT id, list_filter(range(64), lambda i: coords[i + 1] > 512) AS s, coords FROM pts) SELECT a.id, round(1 - len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::DOUBLE, 9) AS jaccard, round(list_sum(list_transform(list_zip(a.coords, b.coords), lambda z: z[1]::BIGINT * z[2]))::DOUBLE / (sqrt(list_sum(list_transform(a.coords, lambda x: x::BIGINT * x))::DOUBLE) * sqrt(list_sum(list_transform(b.coords, lambda x: x::BIGINT * x))::DOUBLE)), 9) AS cosine FROM s a JOIN s b ON b.id = a.id + 1")
def set_similarity(spark, d):
    p = pts(spark, d).withColumn("s", F.expr("filter(sequence(0, 63), i -> coords[i] > 512)"))
    b = p.select((F.col("id") - 1).alias("id"), F.col("s").alias("s2"), F.col("coords").alias("c2"))
    return p.join(b, "id").select("id", F.round(P.jaccard_distance(F.col("s"), F.col("s2")), 9).alias("jaccard"), F.round(P.cosine_similarity(F.col("coords"), F.col("c2")), 9).alias("cosine"))


@query("run_segments", "WITH s AS (SELECT user_id, value > 50 AS s, lag(value > 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM events) SELECT user_id, count(*) FILTER (l IS NULL OR l <> s) AS segments, count(*) AS rows FROM s GROUP BY user_id")
def run_segments(spark, d):
    return runs.run_segments(table(spark, d, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], F.col("value") > 50)


@query("kendall_tau", f"WITH {_PTS}, r AS (SELECT label AS id, sum(coords[1])::BIGINT AS x, sum(coords[2])::BIGINT AS y FROM pts GROUP BY label), p AS (SELECT sign(a.x - b.x) AS s, sign(a.y - b.y) AS t FROM r a JOIN r b ON a.id < b.id) SELECT round(sum(s * t) / count(*)::DOUBLE, 9) AS tau_a, round(sum(s * t) / sqrt(sum(abs(s)) * sum(abs(t))), 9) AS tau_b FROM p")
def kendall_tau(spark, d):
    r = pts(spark, d).groupBy(F.col("label").alias("id")).agg(F.sum(F.col("coords")[0]).alias("x"), F.sum(F.col("coords")[1]).alias("y"))
    return stats.kendall_tau(r).select(F.round("tau_a", 9).alias("tau_a"), F.round("tau_b", 9).alias("tau_b"))


def _drawn(p, some):
    """Size of a sample, its different ids, and how many of them are ids of the table."""
    known = p.select("id", F.lit(1).alias("known"))
    return some.join(known, "id", "left").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count("known").alias("known"))


@query("sample_points", f"WITH {_PTS} SELECT least(100, count(*)) AS n, least(100, count(*)) AS ids, least(100, count(*)) AS known FROM pts")
def sample_points(spark, d):
    """A sampling operator: exactly 100 different points by keyed hash, counted."""
    p = pts(spark, d)
    return _drawn(p, order.sample_exact(p.select("id", "label"), 100, seed=5))


@query("stratified_sample", f"WITH {_PTS} SELECT label, least(5, count(*)) AS n FROM pts GROUP BY label")
def stratified_sample(spark, d):
    """A sampling operator: exactly five points of every label, counted."""
    return order.sample_by(pts(spark, d), "label", 5, seed=5).groupBy("label").agg(F.count_distinct("id").alias("n"))


@query("shuffled_points", f"WITH {_PTS} SELECT count(*) AS n, count(*) - 1 AS last, count(*) AS places FROM pts")
def shuffled_points(spark, d):
    """Every point once at a random place."""
    return order.shuffled(pts(spark, d).select("id"), seed=5).agg(F.count_distinct("id").alias("n"), F.max("place").alias("last"), F.count_distinct("place").alias("places"))


@query("order_search")
def order_search(spark, d):
    """Best permutation of the dimensions and its number of clusters."""
    perm, k = classify.order_search(pts(spark, d), DIMS, BITS, outlier=2, rounds=3)
    return spark.createDataFrame([(",".join(map(str, perm)), k)], "perm string, clusters int")


@query("curve_classify")
def curve_classify(spark, d):
    return classify.curve_classify(pts(spark, d), DIMS, BITS)[0]


@query("density_split")
def density_split(spark, d):
    return classify.density_split(pts(spark, d), DIMS, BITS, 400_000)


@query("frugal_quantile")
def frugal_quantile(spark, d):
    """Online median of event values (in cents) per user, in the order of events."""
    e = table(spark, d, "events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return batch_quantile(e, "user_id", "cents", "event_id", 0.5)


@query(
    "shuffled_quantile",
    """WITH e AS (SELECT user_id, round(value * 100)::BIGINT AS cents FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL), r AS (SELECT user_id, cents, row_number() OVER (PARTITION BY user_id ORDER BY cents) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM e)
SELECT user_id, n, max(CASE WHEN n < 100 AND rn = greatest(1, ceil(0.5 * n)) THEN cents END) AS exact, true AS fair FROM r GROUP BY user_id, n""",
)
def shuffled_query(spark, d):
    """Median of event values per user: exact below 100 values, else estimated in random order and at least between the 20th and the 80th percentile."""
    e = table(spark, d, "events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents")).where("user_id is not null and cents is not null")
    q = shuffled_quantile(e, "user_id", "cents", "event_id", 0.5)
    r = e.join(q, "user_id").groupBy("user_id", "n", "estimate").agg(F.count_if(F.col("cents") < F.col("estimate")).alias("below"), F.count_if(F.col("cents") > F.col("estimate")).alias("above"))
    return r.select("user_id", "n", F.when(F.col("n") < 100, F.col("estimate")).alias("exact"), (F.greatest("below", "above") <= 0.8 * F.col("n")).alias("fair"))


_REF = [f"list_transform(range(64), lambda i: CASE WHEN i % 4 = {r} THEN 1023 ELSE 0 END)" for r in range(4)]


@query("triangulation", f"WITH {_PTS}, r AS (SELECT id, [{', '.join('sqrt(' + _D2.format('coords', x) + '::DOUBLE)' for x in _REF)}] AS r FROM pts) SELECT a.id, list_max(list_transform(list_zip(a.r, b.r), lambda z: pow(z[1] - z[2], 2))) > 40000 AS farther FROM r a JOIN r b ON b.id = a.id + 1")
def triangulation(spark, d):
    """Pairs known to be farther than 200 apart from their distances to four reference points alone."""
    refs = [F.array(*[F.lit(1023 if i % 4 == r else 0) for i in range(64)]) for r in range(4)]
    p = pts(spark, d).select("id", F.array(*[F.sqrt(P.square_distance(F.col("coords"), r).cast("double")) for r in refs]).alias("r"))
    b = p.select((F.col("id") - 1).alias("id"), F.col("r").alias("s"))
    return p.join(b, "id").select("id", (F.array_max(F.zip_with("r", "s", lambda x, y: F.pow(x - y, F.lit(2.0)))) > 40000).alias("farther"))



@query("curve_distance", f"WITH {_PTS}, {_NARROW} SELECT a.id, abs(a.hkey - b.hkey) AS steps FROM k a JOIN k b ON b.id = a.id + 1")
def curve_distance(spark, d):
    """Steps along the narrow curve from each point to the one with the next id."""
    k = order.with_key(pts(spark, d), NARROW, BITS).select("id", "hkey")
    b = k.select((F.col("id") - 1).alias("id"), F.col("hkey").alias("h2"))
    return k.join(b, "id").select("id", curve.curve_distance(F.col("hkey"), F.col("h2")).alias("steps"))


@query(
    "window_volume",
    "WITH g AS (SELECT x.range AS x, y.range AS y FROM range(16) x, range(16) y), k AS (" + curve_key_sql("g", ["x", "y"], 4, "x AS a, y AS b").replace("SELECT x AS a, y AS b, ", "SELECT a, b, ").replace("SELECT a, b, (x)::BIGINT", "SELECT x AS a, y AS b, (x)::BIGINT", 1) + "), w AS (SELECT hkey, (max(a) OVER f - min(a) OVER f + 1) * (max(b) OVER f - min(b) OVER f + 1) / 4.0::DOUBLE AS v FROM k WINDOW f AS (ORDER BY hkey ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) SELECT round(avg(v), 9) AS volume FROM w WHERE hkey <= 252",
)
def window_volume(spark, d):
    """Mean volume, by their number, of the boxes around four successive places of the whole curve in two dimensions at 4 bits."""
    return spark.createDataFrame([(round(runs.window_volume(spark, 2, 4, 4), 9),)], "volume double")


@query("all_permutations", "WITH RECURSIVE p(a) AS (SELECT [i.range] FROM range(5) i UNION ALL SELECT list_append(a, i.range) FROM p, range(5) i WHERE len(a) < 5 AND NOT list_contains(a, i.range)) SELECT array_to_string(a, ',') AS perm FROM p WHERE len(a) = 5")
def all_permutations(spark, d):
    return P.all_permutations(spark, 5).select(_text("perm").alias("perm"))


@query("append_coordinate", f"WITH {_PTS} SELECT id, array_to_string(list_append(coords, label), ',') AS coords FROM pts WHERE label IS NOT NULL")
def append_coordinate(spark, d):
    """Points with their label as a further coordinate."""
    return pts(spark, d).where("label is not null").select("id", _text(P.append(F.col("coords"), F.col("label"))).alias("coords"))


@query("point_text", f"WITH {_PTS} SELECT id, '[' || array_to_string(coords[1:10], ',') || ',...]' AS text FROM pts")
def point_text(spark, d):
    return pts(spark, d).select("id", P.point_text(F.col("coords")).alias("text"))


@query("sparse_access", f"WITH {_PTS} SELECT id, CASE WHEN abs(coords[8] - 512) > 60 THEN coords[8] ELSE 512 END AS at7, len(list_filter(coords, lambda x: abs(x - 512) > 60)) AS present FROM pts")
def sparse_access(spark, d):
    """A coordinate of a sparse point, and how many it has."""
    v = F.expr("map_filter(map_from_arrays(sequence(0, size(coords) - 1), coords), (d, x) -> abs(x - 512) > 60)")
    return pts(spark, d).select("id", P.sparse_get(v, 7, F.lit(512)).alias("at7"), F.size(v).cast("long").alias("present"))


@query("drawn_coordinates", f"WITH {_PTS} SELECT id, true AS kept, true AS drawn FROM pts")
def drawn_coordinates(spark, d):
    """Sparse points whose missing coordinates are drawn from 0 and 1023: present ones must be kept, others drawn."""
    v = F.expr("map_filter(map_from_arrays(sequence(0, size(coords) - 1), coords), (d, x) -> abs(x - 512) > 60)")
    x = pts(spark, d).select("id", "coords", P.densify_drawn(v, DIMS, F.col("id"), F.array(F.lit(0), F.lit(1023))).alias("c"))
    return x.select("id", F.expr("forall(sequence(0, 63), i -> abs(coords[i] - 512) <= 60 or c[i] = coords[i])").alias("kept"), F.expr("forall(sequence(0, 63), i -> abs(coords[i] - 512) > 60 or c[i] in (0, 1023))").alias("drawn"))


_BKEY = "bk AS (" + wide_key_sql("bp", "coords", BITS, "id") + ")"


@query("balanced_sort", f"WITH {_BAL}, {_BKEY} SELECT id, hkey, row_number() OVER (ORDER BY hkey, id) - 1 AS pos FROM bk")
def balanced_sort(spark, d):
    """Order along the curve of the balanced points, whose values take 10 bits."""
    return balance.balanced_index(pts(spark, d), DIMS, BITS).select("id", F.hex("hkey").alias("hkey"), "pos")


@query("key_range", "SELECT min(vec_id) AS low, max(vec_id) AS high, count(vec_id) AS n, max(vec_id) - min(vec_id) + 1 <= 2 * count(DISTINCT vec_id) AS dense FROM embeddings")
def key_range(spark, d):
    return stats.key_range(table(spark, d, "embeddings"), "vec_id")


@query("label_set", "SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL")
def label_set(spark, d):
    return pts(spark, d).select("label").where("label is not null").distinct()


def _ratings(p):
    """Ratings in the form of the points: users are points, an item is the rest of a label by 4, the rating the first coordinate."""
    return p.select(F.col("id").alias("user"), (F.col("label") % 4).alias("item"), F.col("coords")[0].alias("rating"))


@query("mean_rating_error", f"WITH {_PTS}, r AS (SELECT id, label % 4 AS item, coords[1] AS rating FROM pts), m AS (SELECT item, avg(rating) AS mean FROM r WHERE id % 20 <> 0 GROUP BY item) SELECT round(sqrt(avg(pow(rating - mean, 2))), 6) AS rms, count(*) AS n FROM r JOIN m USING (item) WHERE id % 20 = 0")
def mean_rating_error(spark, d):
    r = _ratings(pts(spark, d))
    return knn.mean_rating_error(r, r.where("user % 20 = 0")).select(F.round("rms", 6).alias("rms"), "n")


@query(
    "inferred_ratings",
    f"""WITH {_IDX}, r AS (SELECT id, pos, label % 4 AS item, coords[1] AS rating FROM idx),
n AS (SELECT a.id AS user, a.item, b.rating, row_number() OVER (PARTITION BY a.id, a.item ORDER BY abs(a.pos - b.pos), b.id) AS rn FROM r a JOIN r b ON a.item = b.item AND a.id <> b.id WHERE a.id % 20 = 0 QUALIFY rn <= {K}),
w AS (SELECT *, count(*) OVER (PARTITION BY user, item) - rn + 1 AS w FROM n)
SELECT user, item, round(sum(w * rating) / sum(w)::DOUBLE, 6) AS rating FROM w GROUP BY user, item""",
)
def inferred_ratings(spark, d):
    """The rating of each asking user, from the nearest other raters of the item along the curve."""
    i = index(spark, d)
    r = _ratings(i)
    return knn.inferred_ratings(i, r, r.where("user % 20 = 0").select("user", "item"), K).select("user", "item", F.round("rating", 6).alias("rating"))


@query("joined_labels", f"WITH RECURSIVE {_PTS}, {_CEN}, e AS (SELECT a.label AS a, b.label AS b FROM cen a JOIN cen b ON a.label <> b.label WHERE {_D2.format('a.centroid', 'b.centroid')} <= 300000), w(n, r) AS (SELECT label, label FROM cen WHERE label IN (SELECT a FROM e) UNION SELECT e.b, w.r FROM w JOIN e ON e.a = w.n WHERE w.r < e.b) SELECT n AS name, min(r) AS root FROM w GROUP BY n")
def joined_labels(spark, d):
    """Labels tied by centroids at most 300,000 apart, directly or through others."""
    c = stats.centroids(pts(spark, d))
    o = c.select(F.col("label").alias("b"), F.col("centroid").alias("c2"))
    near = c.select(F.col("label").alias("a"), "centroid").join(o, F.col("a") < F.col("b")).where(P.square_distance(F.col("centroid"), F.col("c2")) <= 300_000)  # a few labels
    return groups.joined_names(near.select("a", "b"))


_DELIVERED = {"points": (["point_id"], ["dataset_id", "coords"]), "dimension_values": (["reading_id"], ["dataset_id", "dim_no", "obs_day", "coord"]), "raw_lines": (["file_id", "line_no"], ["raw_line"])}


@query(
    "repeated_deliveries",
    " UNION ALL ".join(
        f"SELECT '{t}' AS name, count(*) AS keys, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (k > 1) AS differing FROM (SELECT count(*) AS n, count(DISTINCT {{{', '.join(f'{c!r}: {c}' for c in cols)}}}) AS k FROM {t} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in keys)} GROUP BY {', '.join(keys)})"
        for t, (keys, cols) in _DELIVERED.items()
    ),
)
def repeated_deliveries(spark, d):
    """Rows delivered again in the tables whose readers keep one of them, and keys whose deliveries differ."""
    out = None
    for t, (keys, cols) in _DELIVERED.items():
        r = stats.repeats(table(spark, d, t), keys, cols).select(F.lit(t).alias("name"), "keys", "repeated", "differing")
        out = r if out is None else out.unionByName(r)
    return out
