"""Operator 2's blocks against a matrix product: over noise, smooth vectors, ties and large numbers; time and rows moved."""

import time

import numpy as np
import pytest

pytest.importorskip("coppice.llm")

from coppice.llm import topk  # noqa: E402


def met(rows, n, step, k=5):
    """A block of the first n rows that has met all rows."""
    keys = np.arange(len(rows))
    block = topk.Block(keys[:n], rows[:n], keys[:n], k)
    for x in range(0, len(rows), step):
        block.meet(keys[x : x + step], np.zeros(len(keys[x : x + step]), bool), rows[x : x + step], keys[x : x + step])
    return block


def right(block, rows, n, k=5):
    """Each query's best scores, ties to the smaller id."""
    scores = rows[:n].astype(object) @ rows.T.astype(object) if np.abs(rows.astype(float)).max() > 1 << 20 else rows[:n].astype(np.int64) @ rows.T.astype(np.int64)
    for q in range(n):
        best = sorted((-s, c) for c, s in enumerate(scores[q].tolist()) if c != q)[:k]
        assert [(-s, c) for s, c in zip(block.score[q].tolist(), block.vec[q].tolist(), strict=True)] == best
    assert block.found.all()


def noise(rng, n, width=64):
    x = rng.normal(size=(n, width))
    return np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)


def smooth(rng, n, width=64):
    """Few kinds of vectors, even over each segment but for little: most pairs are ruled out by bounds."""
    kinds = np.repeat(rng.normal(size=(n // 20, width // 16)), 16, axis=1)
    x = kinds[rng.integers(0, len(kinds), n)] + 0.01 * rng.normal(size=(n, width))
    return np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)


@pytest.mark.parametrize("rows", [noise(np.random.default_rng(1), 4000), smooth(np.random.default_rng(2), 4000), np.random.default_rng(3).integers(-1, 2, (4000, 5)), np.random.default_rng(4).integers(-(1 << 18), 1 << 18, (3000, 16)), np.ones((3000, 3), np.int16), np.arange(4000)[:, None]], ids=["noise", "smooth", "ties", "wide", "same", "rising"])
def test_best_scores(rows):
    right(met(rows, 60, 1500), rows, 60)


def test_several_tiles_of_queries():
    rows = smooth(np.random.default_rng(5), 6000)
    block = met(rows, 2500, 6000)
    right(block, rows, 60)
    scores = rows[:2500] @ rows.T
    np.fill_diagonal(scores, -(1 << 40))
    assert (block.score == np.sort(scores, axis=1)[:, :-6:-1]).all()


def test_large_numbers():
    """Scores beyond 64 bits are held at their ends, and tie there."""
    rows = np.random.default_rng(6).integers(-(1 << 40), 1 << 40, (300, 4))
    rows[7], rows[8] = 1 << 28, -(1 << 28)
    scores = rows[:9].astype(object) @ rows.T.astype(object)
    block = met(rows, 9, 300)
    for q in range(9):
        best = sorted((-min(max(s, -(1 << 63) + 1), (1 << 63) - 1), c) for c, s in enumerate(scores[q]) if c != q)[:5]
        assert [(-s, c) for s, c in zip(block.score[q].tolist(), block.vec[q].tolist(), strict=True)] == best


def test_noise_takes_little_more_than_a_matrix_product():
    """Bounds rule out nothing over noise; they took some 240 times the plain product's time."""
    rows = noise(np.random.default_rng(7), 20_000)
    began = time.process_time()
    met(rows, 1000, 5000)
    took = time.process_time() - began
    plain = []
    for _ in range(5):
        began = time.process_time()
        np.count_nonzero(rows[:1000].astype(np.float32) @ rows.T.astype(np.float32) > 1e9)
        plain.append(time.process_time() - began)
    assert took < 60 * np.median(plain)


def test_several_blocks_and_parts(spark, monkeypatch):
    """Queries of several blocks meet all parts, and give what one block gives."""
    rows = noise(np.random.default_rng(8), 2000, 8) / 256
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows.tolist())], "vec_id long, embedding array<double>")
    one = sorted(tuple(r) for r in topk.search(spark, df, "vec_id % 10 = 0").collect())
    monkeypatch.setattr(topk, "HELD", 8 * 30)
    monkeypatch.setattr(topk, "VECTORS", 150)
    assert topk.cells(2000, 200, 8, 4) == (7, 16)
    assert sorted(tuple(r) for r in topk.search(spark, df, "vec_id % 10 = 0").collect()) == one and len(one) == 1000


def test_rows_moved():
    """15 million vectors of 64 components, some 6 GB: their copies are few."""
    n, asked = 15_400_000, 308_000
    blocks, parts = topk.cells(n, asked, 64, 6)
    assert n * blocks + asked * parts < 4 * n and parts % 6 == 0
