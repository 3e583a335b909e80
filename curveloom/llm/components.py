"""Problem 1: pairwise matches consolidated into groups, by deterministic Boruvka hooking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Stages, table


def star_edges(members: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Edges that tie all items of one key to its smallest item: as many as rows, never all pairs of a group."""
    heads = members.groupBy(*keys).agg(F.min(item).alias("a"))
    return members.join(heads, keys).select("a", F.col(item).alias("b"))


def connected_groups(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the smallest node of its component.

    Each round every component selects its smallest outgoing edge, which is the one to its smallest neighbour; as edges are totally
    ordered the chosen ones form trees with one two-node cycle each, cut at its smaller node. Trees collapse by pointer doubling, edges
    are relabelled and made distinct, until none is left. All tables stay distributed; a node with very many edges is pre-reduced by
    the map-side part of ``min`` and its joins are split by adaptive execution. Rows with a null end and loops tie nothing;
    a node that has only such rows isn't in the result; an empty input gives an empty result. Edges left after ``max_rounds`` (each at least halves the components) are an error.
    """
    spark = edges.sparkSession
    work = Stages(spark, "groups")
    e = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct()
    e = work.write(e)
    maps: list[DataFrame] = []
    for _ in range(max_rounds):
        if not maps and e.isEmpty():
            return spark.createDataFrame([], "node bigint, root bigint")
        best = e.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("p")), F.struct(F.col("b").alias("node"), F.col("a").alias("p")))).alias("x")).select("x.*").groupBy("node").agg(F.min("p").alias("p"))
        p = work.write(best)
        other = p.select(F.col("node").alias("p"), F.col("p").alias("gp"))
        # the smaller node of a mutual choice is the root; two steps of doubling in the same pass
        rooted = p.join(other, "p").select("node", F.when((F.col("gp") == F.col("node")) & (F.col("node") < F.col("p")), F.col("node")).otherwise(F.col("p")).alias("p"))
        old, p = p, work.write(rooted)
        work.drop(old)
        while True:
            up = p.select(F.col("node").alias("p"), F.col("p").alias("gp"))
            up2 = p.select(F.col("node").alias("gp"), F.col("p").alias("ggp"))
            step = p.join(up, "p").join(up2, "gp").select("node", F.col("ggp").alias("p"), (F.col("ggp") != F.col("p")).alias("moved"))
            old, p = p, work.write(step)
            work.drop(old)
            if p.where("moved").isEmpty():
                break
            p = _plain(p, work)
        maps.append(p.select("node", F.col("p").alias("root")))
        ra, rb = p.select(F.col("node").alias("a"), F.col("p").alias("ra")), p.select(F.col("node").alias("b"), F.col("p").alias("rb"))
        e2 = e.join(ra, "a").where("true").join(rb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        old, e = e, work.write(e2)
        work.drop(old)
        if e.isEmpty():
            break
    else:
        raise RuntimeError(f"edges are left after {max_rounds} rounds")
    out = maps.pop()
    while maps:  # roots of a round are nodes of the next one, or roots for good
        nxt = out.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        out = maps.pop().join(nxt, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    return out


def _plain(p: DataFrame, work: Stages) -> DataFrame:
    q = p.select("node", "p")
    work.paths[id(q)] = work.paths.pop(id(p))
    return q


def match_edges(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Ties of both sources. Null and negative ids and null or empty labels tie nothing; a label holds for its own pass only."""
    a = pairs.select(F.col("point_a").alias("a"), F.col("point_b").alias("b")).where("a >= 0 and b >= 0 and a <> b")
    m = members.select("pass_no", "label", "point_id").where("point_id >= 0 and label is not null and label <> '' and pass_no is not null")
    return a.unionByName(star_edges(m, ["pass_no", "label"], "point_id").where("a <> b"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = connected_groups(match_edges(table(spark, sf_dir, "match_pairs"), table(spark, sf_dir, "label_members")))
    return groups.select(F.col("node").alias("point_id"), F.col("root").alias("group_id"))


def p1_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of groups by their size."""
    sizes = p1_found(spark, sf_dir).groupBy("group_id").count()
    return sizes.groupBy(F.col("count").alias("members")).agg(F.count("*").alias("n_groups"))


QUERIES = {"p1_found": p1_found, "p1_group_sizes": p1_group_sizes}

_GROUPS = """
WITH RECURSIVE m AS (SELECT DISTINCT pass_no, label, point_id FROM label_members WHERE point_id >= 0 AND label IS NOT NULL AND label <> '' AND pass_no IS NOT NULL),
h AS (SELECT pass_no, label, min(point_id) AS a FROM m GROUP BY ALL),
e0 AS (SELECT point_a AS a, point_b AS b FROM match_pairs WHERE point_a >= 0 AND point_b >= 0 AND point_a <> point_b
       UNION SELECT h.a, m.point_id FROM m JOIN h USING (pass_no, label) WHERE h.a <> m.point_id),
e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
walk(point_id, group_id) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, w.group_id FROM walk w JOIN e ON e.a = w.point_id WHERE w.group_id < e.b),
g AS (SELECT point_id, min(group_id) AS group_id FROM walk GROUP BY point_id)
"""
SQL = {
    "p1_found": _GROUPS + "SELECT point_id, group_id FROM g",
    "p1_group_sizes": _GROUPS + "SELECT members, count(*) AS n_groups FROM (SELECT group_id, count(*) AS members FROM g GROUP BY group_id) GROUP BY members",
}
