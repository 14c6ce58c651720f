import random

from quillgraph.llm.components import components


def test_both_ways_match_brute_force(spark):
    rnd = random.Random(9)
    links = [(rnd.randrange(-50, 400), rnd.randrange(-50, 400)) for _ in range(250)]
    links += [(1000 + i, 1001 + i) for i in range(40)] + [(7, 2000 + i) for i in range(60)] + [(3, 3), (5, 9), (9, 5)]
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root if any(x in link and link[0] != link[1] for link in links)}
    df = spark.createDataFrame(links, "a long, b long")
    for one_task in (10**6, 0):
        assert {r.node: r.component for r in components(df, one_task).collect()} == want


def test_empty(spark):
    for one_task in (10, -1):
        assert components(spark.createDataFrame([], "a long, b long"), one_task).collect() == []
