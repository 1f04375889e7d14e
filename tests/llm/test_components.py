import random

from spendtrace.llm.components import connected_components


def brute(edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_chains_stars_and_random_edges(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(i, 200) for i in range(201, 230)]
    edges += [(rng.randint(300, 500), rng.randint(300, 500)) for _ in range(150)]
    edges += [(1000, 999), (999, 1000)]
    frame = spark.createDataFrame(edges + [(7, 7), (None, 5), (5, None)], "a long, b long")
    got = {r.id: r.component for r in connected_components(frame).collect()}
    assert got == brute([e for e in edges if e[0] != e[1]])


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
