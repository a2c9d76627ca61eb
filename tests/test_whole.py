"""Queries that do the whole job: rows that a filter or a limit would lose."""

import numpy as np
import pytest

from coppice.operators import vectors
from coppice.plans import search


@pytest.fixture
def embedded(spark, tmp_path):
    """Ids 0 to 8 and 100: two of them are query vectors, one a label."""
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 2 if i < 100 else 1), [float(x) for x in rng.random(4)]) for i in (*range(9), 100)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path), [(i, k, np.array(e, np.float32).astype(float)) for i, k, e in rows]


def test_matrices_hold_all_rows(spark, embedded):
    where, rows = embedded
    asked = [r for r in rows if r[0] % 100 == 0]
    got = {(r.q_vec_id, r.t_vec_id): r.value for r in vectors.alignment_matrix(spark, where).collect()}
    assert got == {(q, t): pytest.approx(np.log((np.maximum(0, a - b) ** 2).sum() + 1e-7), abs=2e-6) for q, _, a in asked for t, _, b in rows}
    got = {(r.q_vec_id, r.t_vec_id): r.cost for r in vectors.pairwise_cost_matrix(spark, where).collect()}
    assert got == {(q, t): pytest.approx(((a - b) ** 2).sum(), abs=2e-6) for q, _, a in asked for t, _, b in rows}


def test_transport_takes_all_rows(spark, embedded):
    where, rows = embedded
    of = lambda k: np.stack([e for _, x, e in rows if x == k])
    want = {(a, b): vectors.transport(((of(a)[:, None] - of(b)[None]) ** 2).sum(axis=2)) for a, b in ((0, 0), (0, 1), (1, 1))}
    got = {(r.label, r.other): r.emd for r in vectors.emd_uniform(spark, where).collect()}
    assert got == {k: pytest.approx(v, abs=2e-6) for k, v in want.items()}


def test_search_passes_six_nodes_and_tells_paths_apart(spark):
    """A root with an order of seven lines grows to all nine nodes; an edge with spans and a 2-path tell sets of equal labels apart."""
    nodes = [(1, 0, "customer", "A"), (1, 64, "order", "F"), *[(1, 64 + k, "line", "AF") for k in range(1, 8)]]
    edges = [(1, 0, 64), *[(1, 64, 64 + k) for k in range(1, 8)]]
    nodes, edges = spark.createDataFrame(nodes, "prog long, node long, type string, span string"), spark.createDataFrame(edges, "prog long, src long, dst long")
    found = search.search(spark, nodes, edges)
    assert max(r.gen for r in found.collect()) == 9
    kinds = [(1, 0, "x", "p"), (1, 1, "y", "q"), (1, 2, "z", "r"), (2, 0, "x", "p"), (2, 1, "y", "q"), (2, 2, "z", "r"), (2, 3, "y", "q")]
    named = search.labelled(spark.createDataFrame(kinds, "prog long, node long, type string, span string"), spark.createDataFrame([(1, 0, 1), (1, 1, 2), (2, 0, 3), (2, 1, 2)], "prog long, src long, dst long"))
    sets = spark.createDataFrame([(p, n, a) for p, a in ((1, [0, 1, 2]), (2, [0, 3, 1, 2])) for n in a], "prog long, node long, all array<long>")
    tokens = {r.prog: sum(r.phi) for r in search.encode(sets, named, ["prog"]).collect()}
    assert tokens == {1: 6 + 2 + 2 + 1, 2: 8 + 2 + 2}
