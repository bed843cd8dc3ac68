"""Components against union-find on random graphs."""

import random

import pytest

from shiftlog.llm.components import components


def smallest(links):
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)]
    chain = list(range(1000, 1060))
    rng.shuffle(chain)
    links += list(zip(chain, chain[1:]))
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == smallest([x for x in links if x[0] != x[1]])


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_merged_in_rounds_is_components_of_all(spark):
    from shiftlog.llm.components import merged
    rng = random.Random(8)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    whole = None
    for at in (0, 10, 11, 30, 45):
        part = links[at:{0: 10, 10: 11, 11: 30, 30: 45, 45: 45}[at]]
        whole = merged(whole, spark.createDataFrame(part, "a long, b long"))
    want = components(spark.createDataFrame(links, "a long, b long"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, want.collect()))
