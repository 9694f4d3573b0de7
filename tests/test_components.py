import random

from weftgraph.operators.components import components


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {x: find(x) for x in list(parent)}


def test_components_match_union_find(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(1000, 1060)]
    noise = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    star = [(5000, i) for i in range(5001, 5100)]
    edges = chain + noise + star + noise[:5] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.root for r in components(df).collect()} == brute(edges)
    assert components(df.limit(0)).count() == 0
