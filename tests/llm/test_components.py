import random

import pytest

from lodestar.llm import components
from lodestar.llm.common import persist


def smallest(edges):
    """node -> the smallest node it can reach, by flood fill."""
    near = {}
    for x, y in edges:
        if x != y:
            near.setdefault(x, set()).add(y)
            near.setdefault(y, set()).add(x)
    root = {}
    for start in sorted(near):
        todo = [start] if start not in root else []
        root.setdefault(start, start)
        while todo:
            for y in near[todo.pop()] - root.keys():
                root[y] = start
                todo.append(y)
    return root


def edges():
    """A long chain, a star, sparse links, loops, and links said twice and both ways round."""
    rng = random.Random(9)
    node = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(400)]
    out = list(zip(node[:100], node[1:100], strict=False)) + [(node[100], x) for x in node[101:180]]
    out += [(rng.choice(node[180:]), rng.choice(node[180:])) for _ in range(90)] + [(x, x) for x in node[:3] + node[398:]]
    return out + [(y, x) for x, y in out[::7]] + out[::5]


@pytest.mark.parametrize("most", [0, 10_000])
def test_roots_are_the_smallest_in_reach(spark, monkeypatch, most):
    """By rounds, and by one task."""
    monkeypatch.setattr(components, "TASK_EDGES", most)
    rows = edges()
    got = components.connected_components(persist(spark.createDataFrame(rows, "a long, b long"))).collect()
    assert sorted((r.node, r.root) for r in got) == sorted(smallest(rows).items())
    none = spark.createDataFrame([(1, 1)], "a long, b long")
    assert components.connected_components(persist(none)).collect() == []


def test_few_edges_take_few_jobs(spark):
    """The driver holds something for every task of every job; rounds over this chain are dozens."""
    rows = persist(spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long"))
    sc = spark.sparkContext
    sc.setJobGroup("few edges", "")
    try:
        out = components.connected_components(rows).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(out) == 301 and all(r.root == 0 for r in out)
    assert len(sc.statusTracker().getJobIdsForGroup("few edges")) <= 6


def test_nodes_leave_the_one_task(spark):
    """What is joined with the roots stays spread."""
    rows = persist(spark.createDataFrame([(i, i + 1) for i in range(0, 4000, 2)], "a long, b long"))
    roots = components.connected_components(rows).withColumnRenamed("node", "key")
    nodes = persist(spark.range(4000).repartition(4))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = nodes.hint("merge").join(roots, nodes.id == roots.key)
        assert sum(n > 0 for n in joined.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()) == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
