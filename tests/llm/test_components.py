import random

from threadloom.llm.components import components


def test_chains_stars_and_cycles(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(1000, k) for k in range(1, 40)]
    cycle = [(k, 2000 + (k - 1999) % 20) for k in range(2000, 2020)]
    rnd = random.Random(1)
    loose = [(rnd.randint(5000, 5060), rnd.randint(5000, 5060)) for _ in range(50)]
    edges = chain + star + cycle + loose + chain[:5] + [(b, a) for a, b in star[:7]] + [(77, 77)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
