import random

import pytest

from triledger.operators import components
from triledger.operators.components import connected_components


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    return {x: find(x) for x in root}


def shuffled_path(n, seed):
    names = [f"n{i:03d}" for i in range(n)]
    random.Random(seed).shuffle(names)
    return list(zip(names, names[1:]))


CASES = {
    "path": shuffled_path(30, 1),
    "star": [("hub", f"x{i}") for i in range(40)] + [("x3", "y"), ("y", "a")],
    "random": [(f"n{random.Random(i).randrange(60):02d}", f"n{random.Random(i + 999).randrange(60):02d}") for i in range(45)],
    "loops": [("a", "a"), ("a", "b"), ("b", "a"), ("c", "c")],
    "two agents": [("A|1", "A|2"), ("B|1", "B|3")],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("hot_rows", [5, 1_000_000])
def test_components(spark, name, hot_rows):
    edges = CASES[name]
    out = connected_components(spark.createDataFrame(edges, "u string, v string"), hot_rows=hot_rows)
    expected = {k: v for k, v in plain([e for e in edges if e[0] != e[1]]).items()}
    assert {r.node: r.root for r in out.collect()} == expected


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_whole_stars_leave_before_the_rounds(spark, monkeypatch):
    pairs = [(f"a{i}", f"b{i}") for i in range(30)]
    # The middle of "r, q, p" is no centre, and the star around "m" is one; "z1" has two smaller neighbours.
    stars = [("m", "n1"), ("n2", "m"), ("m", "n2")]
    others = [("q", "r"), ("q", "p"), ("z1", "y1"), ("z1", "y2"), ("c", "d"), ("e", "d"), ("e", "f")]
    seen, step = [], components._large_star
    monkeypatch.setattr(components, "_large_star", lambda edges, hot: seen.append((edges.count(), hot)) or step(edges, hot))
    for hot_rows in (10, 1_000_000):
        del seen[:]
        out = connected_components(spark.createDataFrame(pairs + stars + others, "u string, v string"), hot_rows=hot_rows).collect()
        assert len(out) == len({r.node for r in out}) and {r.node: r.root for r in out} == plain(pairs + stars + others)
        # No node has more than two neighbours here, so none is busy.
        assert seen[0] == (len(others), None)
    del seen[:]
    assert connected_components(spark.createDataFrame(pairs, "u string, v string")).count() == 60 and seen == []
