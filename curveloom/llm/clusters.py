"""Problem 3: clusters of similar vectors by Markov clustering of the neighbour graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import Stages, table
from ..sources.points import valid_points
from .components import connected_groups
from .links import cluster_links
from .neighbors import nearest_vectors

#: Share of a column under which entries are pruned, most entries of a column (the largest; ties by smaller row), inflation of the first EVEN steps, by which the units have formed, and of
#: later ones, and steps after which an unsettled flow is an error.
PRUNE, MOST, INFLATION, LATER, MAX_STEPS = 0.1, 10, 2.0, 4.0, 60
#: A column is settled when one entry is over CLEAR, or, after EVEN steps, when its largest entry less the sum of its squares is under ALIKE: its entries are alike and stay so.
CLEAR, EVEN, ALIKE = 0.9, 4, 0.05


def _columns(raw: DataFrame, inflation: float, prune: float, most: int, even: bool = False) -> DataFrame:
    """``(c, e, done)``: columns of ``(c, r, v)`` as arrays of (v, r), largest first: the ``most`` largest entries, inflated, pruned and made to sum to 1.

    The entries of a column come from at most ``most`` others or are cut before (see :func:`_largest`), so the arrays gathered are small.
    """
    x = raw.groupBy("c").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("v"), "r"))), 1, most).alias("e"))
    total = "aggregate(e, 0D, (a, x) -> a + x.v)"
    x = x.withColumn("e", F.expr(f"transform(e, x -> named_struct('v', pow(-x.v, {inflation}D), 'r', x.r))")).withColumn("s", F.expr(total))
    x = x.withColumn("e", F.expr(f"filter(e, (x, i) -> i = 0 or x.v >= {prune}D * s)")).withColumn("s", F.expr(total))
    x = x.withColumn("e", F.expr("transform(e, x -> named_struct('v', x.v / s, 'r', x.r))"))
    clear = F.col("e")[0]["v"] > CLEAR
    alike = F.col("e")[0]["v"] - F.expr("aggregate(e, 0D, (a, x) -> a + x.v * x.v)") < ALIKE
    return x.select("c", "e", (clear | alike if even else clear).alias("done"))


def _largest(e: DataFrame, most: int) -> DataFrame:
    """The ``most`` largest entries of every column, ties by smaller row; cut within tasks before anything is shuffled by column."""
    rank = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("v"), "r"))
    return e.withColumn("rn", rank).where(F.col("rn") <= most)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def markov_clusters(edges: DataFrame, inflation: float = INFLATION, prune: float = PRUNE, most: int = MOST, max_steps: int = MAX_STEPS) -> DataFrame:
    """``(id, flow_cluster, inflow)`` of every node of the similarity graph ``edges(a, b, weight)``; flow_cluster is the attractor's id.

    Edges count in both directions, repeats by their largest weight; each node gets a loop of its largest weight. The column-stochastic
    matrix is squared by a join on the middle node, inflated and pruned until every column holds like entries only (one that does is not squared on); the largest (ties: smallest row) is where the
    node's flow goes, and following it leads to the attractor. ``inflow`` is the flow a node receives after the second step, largest for the typical members of a cluster.
    A column never holds more than ``most`` entries, whatever ties there are, so a hub costs as much as any other node and a squaring at most ``most`` ** 2 entries a
    column. Null ends, loops and weights not above 0 are left out; an empty graph gives an empty result; a flow unsettled after ``max_steps`` is an error.
    """
    spark = edges.sparkSession
    work = Stages(spark, "flow")
    e = edges.where("a <> b and weight > 0").select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("r"), "weight"), F.struct(F.col("b").alias("c"), F.col("a").alias("r"), "weight"))).alias("x")).select("x.*")
    e = e.groupBy("c", "r").agg(F.max("weight").alias("v"))
    loop = F.when(F.col("rn") == 1, F.array(F.struct("r", "v"), F.struct(F.col("c").alias("r"), "v"))).otherwise(F.array(F.struct("r", "v")))
    looped = _largest(e, most - 1).select("c", F.explode(loop).alias("x")).select("c", "x.r", "x.v")
    now, kept, inflow = work.write(_columns(looped, 1.0, prune, most)), [], None
    flow = lambda t: t.select("c", F.explode("e").alias("x")).select("c", "x.r", "x.v")
    for step in range(max_steps + 1):
        open_ = now.where("not done")
        if step == 2:
            inflow = work.write(flow(now).groupBy("r").agg(F.sum("v").alias("inflow")).select(F.col("r").alias("id"), "inflow"))
        if step >= 2 and open_.isEmpty():
            break
        if step == max_steps:
            raise RuntimeError(f"the flow has not settled after {max_steps} steps")
        if step < 2:
            open_ = now
        else:  # a settled column keeps its place of flow alone and is not squared on
            kept.append(now.where("done").select("c", F.expr("array(named_struct('v', 1D, 'r', e[0].r))").alias("e")))
        left = flow(open_).select("c", F.col("r").alias("k"), F.col("v").alias("va"))
        right = _union([*kept, open_.select("c", "e")]).select(F.col("c").alias("k"), "e")
        met = left.join(right, "k").select("c", "va", F.explode("e").alias("x")).select("c", F.col("x.r").alias("r"), (F.col("va") * F.col("x.v")).alias("v"))
        squared = met.repartition("c").groupBy("c", "r").agg(F.sum("v").alias("v"))
        now = work.write(_columns(squared, inflation if step < EVEN else max(inflation, LATER), prune, most, step >= EVEN))
    to = work.write(_union([*kept, now.select("c", "e")]).select(F.col("c").alias("id"), F.expr("e[0].r").alias("p"), F.lit(True).alias("moved")))
    while not to.where("moved").isEmpty():  # flow of flow, by doubling: columns may settle on a node whose own flow goes on
        up = to.select(F.col("id").alias("p"), F.col("p").alias("pp"))
        old, to = to, work.write(to.join(up, "p").select("id", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
        work.drop(old)
        if work.n > 4 * max_steps:
            raise RuntimeError("the flow runs in a circle")
    return to.join(inflow, "id", "left").select("id", F.col("p").alias("flow_cluster"), F.coalesce("inflow", F.lit(0.0)).alias("inflow"))


def flow_clusters(points: DataFrame, k: int = 5, merge: bool = True) -> DataFrame:
    """``(id, grp, cluster_id, flow_cluster, inflow, size, outlier)`` of every point; one that no step reaches is its own cluster.

    Exact copies are one node of the similarity graph, which ties each to its nearest within ``lim``; Markov clustering divides it into units, each around an attractor.
    With ``merge`` units that a step of at most ``lim`` ties become one cluster, by an exact check over all rows: its cells are built around the attractors and it compares
    points only where a cell can hold a step between different units. cluster_id is the smallest id of the cluster; flow_cluster names the unit. Without ``merge`` the units themselves are the clusters.
    """
    spark = points.sparkSession
    work = Stages(spark, "clusters")
    pts = work.write(points)
    nodes = work.write(pts.groupBy("grp", "coords").agg(F.min("id").alias("id"), F.max("lim").alias("lim")))
    best, _ = nearest_vectors(nodes, k, distinct=True)
    graph = work.write(best.select(F.col("id").alias("a"), F.col("nbr").alias("b"), "d2").join(nodes.select(F.col("id").alias("a"), "lim"), "a"))
    flow = markov_clusters(graph.select("a", "b", F.expr("1 / (1 + 8 * d2 / greatest(lim, 1))").alias("weight")))
    unit = work.write(nodes.join(flow, "id", "left").select("id", "grp", "coords", "lim", F.coalesce("flow_cluster", "id").alias("flow_cluster"), F.coalesce("inflow", F.lit(0.0)).alias("inflow")))
    named = unit.select("id", "flow_cluster", "inflow", F.col("flow_cluster").alias("root"))
    if merge:
        size = unit.groupBy(F.col("flow_cluster").alias("id")).agg(F.count("*").alias("weight"))
        links = cluster_links(unit.select("id", "grp", "coords", "lim", F.col("flow_cluster").alias("comp")), unit.where("id = flow_cluster").select("grp", "id", "coords").join(size, "id"))
        if not links.isEmpty():
            named = work.write(_joined(named, connected_groups(links)))
    whose = nodes.select(F.col("id").alias("node"), "grp", "coords").join(named.withColumnRenamed("id", "node"), "node")
    every = work.write(pts.select("id", "grp", "coords", "outlier").join(whose, ["grp", "coords"]).select("id", "grp", "root", "flow_cluster", "inflow", "outlier"))
    names = every.groupBy("root").agg(F.min("id").alias("cluster_id"), F.count("*").alias("size"))
    return every.join(names, "root").select("id", "grp", "cluster_id", "flow_cluster", "inflow", "size", "outlier")


def _joined(named: DataFrame, groups: DataFrame) -> DataFrame:
    """Roots replaced by those of the groups they are in."""
    to = groups.select(F.col("node").alias("root"), F.col("root").alias("whole"))
    return named.join(to, "root", "left").select("id", "flow_cluster", "inflow", F.coalesce("whole", "root").alias("root"))


def describe_clusters(members: DataFrame, typical: int = 3) -> DataFrame:
    """``(grp, cluster_id, size, units, is_stray, typical)``: size, number of flow units joined, and the ids of the strongest flow of each cluster, ties by smaller id."""
    w = Window.partitionBy("cluster_id").orderBy(F.desc("inflow"), "id")
    top = members.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= typical)
    d = top.groupBy("grp", "cluster_id").agg(F.max("size").alias("size"), (F.max("size") <= F.max("outlier")).alias("is_stray"), F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"]).alias("typical"))
    units = members.groupBy("cluster_id", "flow_cluster").agg(F.lit(1).alias("one")).groupBy("cluster_id").agg(F.sum("one").alias("units"))
    return d.join(units, "cluster_id").select("grp", "cluster_id", "size", "units", "is_stray", "typical")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_points(table(spark, sf_dir, "points"), table(spark, sf_dir, "datasets"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = flow_clusters(_points(spark, sf_dir))
    return m.where("size > outlier").select(F.col("id").alias("point_id"), "cluster_id")


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with their size and how many of their typical members are members, distinct and of their own dataset (all should be)."""
    m = Stages(spark, "members").write(flow_clusters(_points(spark, sf_dir)))
    d = describe_clusters(m).where("not is_stray").select("grp", "cluster_id", "size", F.explode("typical").alias("id"))
    own = m.select("id", F.col("cluster_id").alias("c"), F.col("grp").alias("g"))
    return d.join(own, "id", "left").groupBy("grp", "cluster_id", "size").agg(F.countDistinct(F.when((F.col("c") == F.col("cluster_id")) & (F.col("g") == F.col("grp")), F.col("id"))).alias("typical_members"))


def p3_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with the flow units joined in them and their most typical members."""
    d = describe_clusters(Stages(spark, "members").write(flow_clusters(_points(spark, sf_dir))))
    return d.where("not is_stray").select("grp", "cluster_id", "size", "units", F.concat_ws(",", F.transform("typical", lambda x: x.cast("string"))).alias("typical"))


QUERIES = {"p3_found": p3_found, "p3_clusters": p3_clusters, "p3_typical": p3_typical}

_POINTS = """p AS (SELECT DISTINCT p.point_id AS id, p.dataset_id AS grp, p.coords, d.merge_square_distance AS lim, d.outlier_size AS outlier FROM points p JOIN datasets d USING (dataset_id)
  WHERE p.coords IS NOT NULL AND len(p.coords) = d.dims AND NOT list_contains(list_transform(p.coords, lambda x: x IS NULL), true))"""
_WALK = f"""
WITH RECURSIVE {_POINTS},
e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.grp = b.grp WHERE a.id = b.id OR list_sum(list_transform(list_zip(a.coords, b.coords), lambda z: (z[1] - z[2])::BIGINT * (z[1] - z[2]))) <= a.lim),
walk(id, c) AS (SELECT id, id FROM p UNION SELECT e.b, w.c FROM walk w JOIN e ON e.a = w.id WHERE w.c < e.b),
g AS (SELECT id, min(c) AS c FROM walk GROUP BY id), s AS (SELECT c, count(*) AS n FROM g GROUP BY c)
"""
#: Exact clusters by all pairs, quick at the scale of the comparison.
SQL = {
    "p3_found": _WALK + "SELECT g.id AS point_id, g.c AS cluster_id FROM g JOIN s USING (c) JOIN p USING (id) WHERE s.n > p.outlier",
    "p3_clusters": _WALK + "SELECT p.grp, s.c AS cluster_id, s.n AS size, least(3, s.n) AS typical_members FROM s JOIN p ON p.id = s.c WHERE s.n > p.outlier",
}
