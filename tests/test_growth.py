"""Steps whose work, disk or memory grew faster than the input, in small pieces and against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coppice.functions import code, sast
from coppice.operators import graphs, programs, reports, text, tiles, trees, triangles, vectors
from coppice.plans import search


def _graph(n, m, seed):
    r = random.Random(seed)
    edges = {tuple(sorted(r.sample(range(n), 2))) for _ in range(m)} | {(0, k) for k in range(1, n)}
    near = {k: {x for e in edges for x in e if k in e and x != k} for k in range(n)}
    want = Counter()
    for a, b in edges:
        for c in near[a] & near[b]:
            want.update({c: 1})
    return sorted(edges), +want


def test_triangles_in_small_pieces(monkeypatch):
    """No more than some edges and wedges at once."""
    monkeypatch.setattr(triangles, "PACKED", 50)
    monkeypatch.setattr(triangles, "WEDGES", 7)
    edges, want = _graph(60, 500, 3)
    batch = lambda e: pa.RecordBatch.from_arrays([pa.array([x[i] for x in e], pa.int64()) for i in (0, 1)], names=["u", "v"])
    rows = [r for b in triangles._dealt(3)(batch(edges[k : k + 40]) for k in range(0, len(edges), 40)) for r in b.to_pylist()]
    rows.sort(key=lambda r: (r["task"], r["kind"]))
    schema = pa.schema([("task", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
    got = Counter()
    for b in triangles._counted(3)(pa.RecordBatch.from_pylist(rows[k : k + 2], schema) for k in range(0, len(rows), 2)):
        for r in b.to_pylist():
            got[r["a"]] += r["t"]
    assert got == want and len({r["task"] for r in rows}) == 6


def test_triangles_of_a_table(spark, monkeypatch):
    """More blocks than the least; no join beside the sum by node, so that no wedge is shuffled."""
    monkeypatch.setattr(triangles, "HELD", 10)
    edges, want = _graph(50, 300, 4)
    found = triangles.triangles(spark.createDataFrame(edges, "u long, v long"), len(edges))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.a: r.t for r in found.collect()} == dict(want)


def test_arrays_are_packed():
    r = np.random.default_rng(1)
    for arrays in ([np.array([], np.int64)], [np.array([5, -(2**62), 2**62]), np.array([], np.int64), r.integers(0, 9, 30)]):
        back = triangles.unpacked(triangles.packed(*arrays))
        assert len(back) == len(arrays) and all(np.array_equal(x, y) for x, y in zip(back, arrays, strict=True))


def test_pairs_meet_in_tiles(spark, tmp_path, monkeypatch):
    """Several blocks of queries; no row a pair; nulls, NaN and vectors of other sizes as in the folds."""
    monkeypatch.setattr(tiles, "QUERIES", 3)
    r = np.random.default_rng(7)
    vs = [(100 * k if k < 8 else k + 1, k % 3, [float(x) for x in np.float32(r.random(5) * 0.9)]) for k in range(40)]
    vs += [(2000, None, None), (2001, 1, [0.5, None, 0.125, 0.25, 0.375]), (2100, 2, [0.5] * 4), (2200, None, [0.125] * 5), (2201, 0, [float("nan")] * 5)]
    spark.createDataFrame(vs, "vec_id long, label int, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    v = spark.createDataFrame(vs, "vec_id long, label int, e array<double>")
    pairs = vectors.against(v.where("vec_id % 100 = 0"), v).withColumn("x", F.expr("aggregate(zip_with(q_e, t_e, (a, b) -> greatest(0.0D, a - b) * greatest(0.0D, a - b)), 0.0D, (s, z) -> s + z)"))
    pairs = pairs.withColumn("d", F.expr("aggregate(zip_with(q_e, t_e, (a, b) -> (a - b) * (a - b)), 0.0D, (s, z) -> s + z)")).withColumn("more", F.expr("if(q_e is null or t_e is null, null, size(filter(zip_with(q_e, t_e, (a, b) -> a > b), z -> z)))")).cache()
    other = pairs.where("q_vec_id <> t_vec_id")
    want = {
        "alignment_matrix": pairs.selectExpr("q_vec_id", "t_vec_id", "round(ln(x + 1e-7), 6)"),
        "pairwise_cost_matrix": pairs.selectExpr("q_vec_id", "t_vec_id", "round(d, 6)"),
        "dominance_frequency": other.groupBy("q_vec_id").agg(F.expr("count_if(x <= 0.5)")),
        "dominance_conjunctive": pairs.groupBy("q_label", "t_vec_id").agg(F.expr("bool_and(x <= 1.0)").alias("ok")).groupBy("q_label").agg(F.expr("count_if(ok)")),
        "dimension_violation_count": other.groupBy("q_vec_id").agg(F.expr("min(more)"), F.expr("sum(more)"), F.expr("count_if(more < 6)")),
        "order_loss": other.groupBy("q_vec_id").agg(F.expr("round(sum(if(q_label = t_label, x, greatest(0.0D, 0.1D - x))), 6)")),
    }
    for name, df in want.items():
        got = vectors.QUERIES[name](spark, str(tmp_path))
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, df.collect()))), name


def test_rounding_is_that_of_sql(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=2000) * 10.0 ** r.integers(-8, 12, 2000), r.integers(-(10**7), 10**7, 2000) / 1e7 * 5, [0.0, -0.0, -1e-9, 1e300, np.inf, -np.inf, np.nan, 0.0000005, 1.0000005]])
    want = [row.y for row in spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "k long, x double").selectExpr("k", "round(x, 6) AS y").orderBy("k").collect()]
    assert list(map(repr, tiles.rounded(x).tolist())) == list(map(repr, want))


def _forest(spark):
    """Programs with cycles, double edges, several parents, labels of none and nulls."""
    r = random.Random(11)
    edges = [(p, r.randrange(25), r.randrange(25)) for p in range(6) for _ in range(40)]
    edges += [(7, 0, k) for k in range(1, 30)] + [(None, 1, 2), (8, 3, None), (8, None, 3), (8, 3, 4), (9, 1, 1)]
    nodes = [(p, k, r.choice("xy"), r.choice(["a", "b", None])) for p in range(10) for k in range(30)]
    return spark.createDataFrame(nodes, "prog long, node long, type string, span string"), spark.createDataFrame(edges, "prog long, src long, dst long")


def test_programs_in_one_pass(spark):
    """As by joins; no join and one exchange by program are left."""
    nodes, edges = _forest(spark)
    same = lambda a, b: sorted(map(repr, map(tuple, a.collect()))) == sorted(map(repr, map(tuple, b.select(*a.columns).collect())))
    near = trees.neighbourhoods(edges, trees.top_degree(edges)).cache()
    sizes = trees.TOP, trees.RADIUS, trees.NEAREST
    assert same(programs.members(edges, *sizes), near) and "Join" not in programs.members(edges, *sizes)._jdf.queryExecution().optimizedPlan().toString()
    inner = trees.induced(edges, near)
    assert same(programs.inner_edges(edges, *sizes), inner)
    free = near.join(inner.select("prog", "anchor", F.col("dst").alias("node")), ["prog", "anchor", "node"], "left_anti").where("node is not null")
    assert same(programs.roots(edges, *sizes), free.groupBy("prog", "anchor").agg(F.min("node").alias("root")))
    plain = edges.dropna()
    assert same(programs.shapes(plain, *sizes), graphs.wl_of_sets(plain, trees.neighbourhoods(plain, trees.top_degree(plain))).groupBy("size", "hash").agg(F.count("*").alias("members"), F.min("prog").alias("first")))
    text = F.md5(F.array_join(F.array_sort(F.collect_list("hop")), ","))
    assert same(programs.outlines(edges, *sizes).where("prog is not null"), near.where("prog is not null").groupBy("prog", "anchor").agg(F.count("*").alias("size"), text.alias("hash"), F.count_if(F.col("hop") == 1).alias("score"), F.count_if(F.col("hop") == 2).alias("holes")))
    for whole in (False, True):
        sets = trees.neighbourhoods(plain, trees.top_degree(plain)).groupBy("prog", "anchor").agg(F.collect_list("node").alias("all"))
        want = search.encode(sets.select("prog", "anchor", "all", F.explode("all").alias("node")), search.labelled(nodes, plain), ["prog", "anchor"], whole)
        assert same(programs.phi_texts(programs.rows_of(nodes, plain), whole, *sizes), want.select("prog", "anchor", F.array_join(F.transform("phi", lambda x: x.cast("string")), ",").alias("phi")))
    counts = programs.phi_counts(programs.rows_of(nodes, plain), *sizes)
    assert same(counts, want.groupBy("phi").agg(F.count("*").alias("n")))


def test_chunks_hold_whole_programs(monkeypatch):
    monkeypatch.setattr(programs, "CHUNK", 10)
    prog = [None] * 3 + [1] * 25 + [2] * 4 + [3] * 4 + [4] * 12
    schema = pa.schema([("prog", pa.int64()), ("span", pa.string())])
    got = list(programs._chunks(pa.RecordBatch.from_pylist([{"prog": p, "span": str(p)} for p in prog[k : k + 3]], schema) for k in range(0, len(prog), 3)))
    assert [p for c in got for p in c[0].tolist()] == [programs.NULL if p is None else p for p in prog]
    assert all(a[0][-1] != b[0][0] for a, b in zip(got, got[1:], strict=False)) and len(got) > 2 and got[0][1][0] == "None"


def test_search_looks_at_its_own_programs(spark):
    """Nodes of programs without a beam aren't kept for the steps."""
    nodes, edges = _forest(spark)
    beams, named, corpus = search.begin(spark, programs.rows_of(nodes, edges), search.Config(seed="a", max_init_beams=2))
    assert {r.prog for r in beams.collect()} == {r.prog for r in named.select("prog").distinct().collect()} == {0, 1}
    assert corpus.agg(F.sum("n")).first()[0] > 50
    kinds = spark.createDataFrame([([0] * 64,), ([1] * 64,)], "phi array<int>")
    table = spark.createDataFrame([([1] * 63 + [0], 3), ([2] * 64, 5)], "phi array<int>, n long")
    assert {r.phi[0]: r.score for r in search.scored(kinds, table).collect()} == {0: 8, 1: 5}


def test_prose_is_not_parsed(spark, monkeypatch):
    """Two names side by side are seen without the parser, and never in a program."""
    for line in ("Orre lire ware", "x = 1 and prose here # if", "é à b", "a\tb"):
        assert sast.hopeless(line) and code.parsed(line) is None
    for line in ("match x:", "type X = int", "not a", "1if x else y", "x # two words", "f('two words')", "if x:\n    y\nz", "case _ if y:", "x \\\n y", "lambda x: x", "async def f(): await g", ""):
        assert not sast.hopeless(line)
    monkeypatch.setattr(sast.ast, "parse", None)
    assert code.masked("some words") is None and not code.valid_case("some words") and sast.rows_of("some words") == []


def test_round_trips_are_not_dealt_out(spark):
    lines = ["np.mean(a) + 1", "two words", "", "x = [1,\n 2]  # note"]
    df = spark.createDataFrame(list(enumerate(lines)), "prog long, code string")
    got = reports.round_trips(df)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.prog: r.code for r in got.collect()} == {k: sast.code_of(sast.rows_of(x)) for k, x in enumerate(lines) if sast.rows_of(x)}


def test_components_shrink(spark, monkeypatch):
    """Each round's edges are fewer: 400 parts in random orders take few rounds, and all rounds write little more than the first."""
    r = random.Random(5)
    pairs = [(2 * o, 2 * r.randrange(400) + 1) for o in range(700) for _ in range(3)] + [(9001, 9001), (10000, 10002), (10004, 10002)]
    sizes, real = [], trees.written
    monkeypatch.setattr(trees, "written", lambda spark, df: (lambda out: (sizes.append((out.columns, out.count())), out)[1])(real(spark, df)))
    got = {x.id: x.root for x in trees.roots_of(spark, spark.createDataFrame(pairs, "u long, v long")).collect()}
    root = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in range(20):
        for u, v in pairs:
            if u != v:
                root[u] = root[v] = min(root[u], root[v])
    assert got == root
    left = [n for c, n in sizes if c == ["u", "v"]]
    assert left[-1] == 0 and len(left) <= 4 and left[0] < 0.7 * len(pairs)


def test_texts_are_cut_into_words_once(spark):
    """Weights as by tfidf, also over rows of one document; the words are in a written table before anything is joined."""
    d = spark.createDataFrame([(k % 40, " ".join(random.Random(k).choices("abcdefgh", k=k))) for k in range(50)] + [(99, "")], "doc_id long, text string")
    got = text.term_weights(d)
    assert "split(" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = text.tfidf(text.postings(d)).groupBy("term").agg(F.round(F.sum("weight"), 6).alias("weight"))
    assert {r.term: r.weight for r in got.collect()} == {r.term: pytest.approx(r.weight, abs=2e-6) for r in want.collect()}


def test_transport_in_rounds():
    """A round serves all columns whose paths have room: far fewer searches than units; sizes without a common divisor."""
    r = np.random.default_rng(3)
    x, y = r.random((90, 8)), r.random((83, 8))
    cost = ((x[:, None] - y[None]) ** 2).sum(axis=2)
    calls = []
    got = vectors.transport(cost.view(type("Counted", (np.ndarray,), {"__add__": lambda a, b: (calls.append(1), np.ndarray.__add__(a, b))[1]})))
    assert got == pytest.approx(1.0 * vectors.transport(cost.T.copy()), abs=1e-12) and got <= cost.mean()
    assert len(calls) < 83 * 90
