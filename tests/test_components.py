"""Connected components against union-find on shapes that are hard for label propagation."""

import random

from casebook.operators.components import connected_components


def brute(edges):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(top)}


def check(spark, edges):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == brute([e for e in edges if None not in e])


def test_long_path_with_random_ids(spark):
    ids = list(range(10_000))
    random.Random(3).shuffle(ids)
    check(spark, list(zip(ids, ids[1:])))


def test_stars_trees_and_odd_rows(spark):
    g = random.Random(5)
    ids = list(range(3_000))
    g.shuffle(ids)
    star_of_stars = [(ids[0], ids[k]) for k in range(1, 40)] + [(ids[1 + k % 39], ids[k]) for k in range(40, 2_000)]
    tree = [(ids[2_000 + (k - 1) // 2], ids[2_000 + k]) for k in range(1, 900)]
    check(spark, [*star_of_stars, *tree, (ids[-1], ids[-1]), (ids[-2], None), (None, 7), *star_of_stars[:5]])
    check(spark, [(g.randrange(400), g.randrange(400)) for _ in range(250)])
    check(spark, [])
