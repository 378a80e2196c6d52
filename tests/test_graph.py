import random

from ledgerline.operators.graph import components


def test_components_are_those_of_plain_python(spark):
    r = random.Random(7)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(5, 5), (1, 2), (2, 1)]
    root = list(range(300))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    nodes = {i for a, b in edges if a != b for i in (a, b)}
    got = {x.id: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chains_and_hubs_end_in_few_rounds(spark):
    r = random.Random(4)
    ids = r.sample(range(10**6), 1500)
    hub = [(3 * 10**6, 2 * 10**6 + k) for k in range(500)]
    rounds = []
    got = {x.id: x.label for x in components(spark.createDataFrame([*zip(ids, ids[1:], strict=False), *hub], "a long, b long"), rounds).collect()}
    assert got == {i: min(ids) for i in ids} | {i: 2 * 10**6 for e in hub for i in e} and len(rounds) <= 13
