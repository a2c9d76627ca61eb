"""Part graphs over all lines, against brute force: most lines are outside the filters of the queries with SQL."""

import random
from collections import defaultdict
from itertools import combinations

import pytest

from coppice.operators import trees


def test_part_graphs_hold_all_lines(spark, tmp_path):
    r = random.Random(2)
    lines = sorted({(r.randrange(40), r.randrange(60)) for _ in range(70)})
    rows = [(o, p, float(r.randrange(1, 51)), r.choice("ARN")) for o, p in lines]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    near, sold = defaultdict(set), defaultdict(set)
    for o, p in lines:
        near[2 * o].add(2 * p + 1)
        near[2 * p + 1].add(2 * o)
        sold[o].add(p)
    root = {}
    for x in sorted(near):
        todo = [x] if x not in root else []
        while todo:
            if (y := todo.pop()) not in root:
                root[y] = x
                todo += near[y]
    assert {x.id: x.root for x in trees.connected_components(spark, str(tmp_path)).collect()} == root
    by = defaultdict(set)
    for parts in sold.values():
        for a, b in combinations(parts, 2):
            by[a].add(b)
            by[b].add(a)
    want = {a: sum(c in by[b] for b, c in combinations(n, 2)) / max(1, len(n) * (len(n) - 1) / 2) for a, n in by.items()}
    assert {x.part: x.c for x in trees.clustering_coefficient(spark, str(tmp_path)).collect()} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
