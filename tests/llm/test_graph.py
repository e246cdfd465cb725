import numpy as np
import pytest

from ledgerline.llm.graph import connected_components


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize(
    "edges",
    [
        [(k, k + 1) for k in range(70)],
        [(k + 1, k) for k in range(0, 140, 2)] + [(5, 5)],
        [(50, k) for k in range(100) if k != 50],
        [(int(a), int(b)) for a, b in np.random.default_rng(4).integers(0, 300, (220, 2))],
        [(10, 1), (1, 9), (9, 2), (2, 8), (8, 3), (3, 7)],
    ],
)
def test_components(spark, edges):
    rows = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    want = brute(edges)
    assert len(rows) == len(want)
    got = {r.node: r.root for r in rows}
    groups = lambda d: sorted(sorted(x for x in d if d[x] == v) for v in set(d.values()))
    assert groups(got) == groups(want)


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
