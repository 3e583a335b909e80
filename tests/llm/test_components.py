from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from curveloom.llm.components import connected_groups, match_edges


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=40))
def test_against_union_find(spark, edges):
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    rows = connected_groups(df).collect()
    assert {r.node: r.root for r in rows} == plain(edges) and len({r.node for r in rows}) == len(rows)


def test_chain_star_and_ties(spark):
    chain = [(i, i + 1) for i in range(0, 300)]
    back = [(1000 - i, 999 - i) for i in range(0, 100)]
    star = [(5000, 6000 + i) for i in range(500)]
    zigzag = [(7000 + (i * 37) % 101, 7000 + ((i + 1) * 37) % 101) for i in range(100)]
    edges = chain + back + star + zigzag + star[:50] + [(8000, 8000), (None, 3), (9, None)]
    df = spark.createDataFrame([(*e, "x") for e in edges], "a bigint, b bigint, root string")
    assert {r.node: r.root for r in connected_groups(df).collect()} == plain(edges)


def test_match_edges(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (None, 4), (-1, 5), (0, 9)], "point_a bigint, point_b bigint")
    members = spark.createDataFrame([(1, "a", 2), (1, "a", 7), (1, "a", 7), (2, "a", 8), (1, "", 10), (1, "", 11), (1, None, 12), (1, None, 13), (3, "b", -4), (3, "b", 14), (3, "b", None), (3, "b", 15)], "pass_no int, label string, point_id bigint")
    got = {r.node: r.root for r in connected_groups(match_edges(pairs, members)).collect()}
    assert got == {1: 1, 2: 1, 7: 1, 0: 0, 9: 0, 14: 14, 15: 14}
    assert connected_groups(match_edges(pairs.where("false"), members.where("false"))).count() == 0
