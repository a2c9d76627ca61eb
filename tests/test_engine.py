"""The engine on a forest small enough to follow by hand, and parse-based scalars and projections against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from coppice import catalogue
from coppice.functions import code
from coppice.operators import graphs
from coppice.plans.engine import Engine, mining, seeded
from coppice.plans.search import Config, labelled
from coppice.sources import files
from coppice.sources.tables import forest


@pytest.fixture(scope="module")
def grove(spark):
    """Four trees: a root, orders F or O, lines AF and NO below them."""
    nodes, edges = [], []
    for p in range(4):
        nodes.append((p, 0, "customer", "B"))
        for o in (64, 128):
            nodes.append((p, o, "order", "F" if (p + o // 64) % 2 else "O"))
            edges.append((p, 0, o))
            for k in range(1, 3 + p % 2):
                nodes.append((p, o + k, "line", "AF" if k == 1 else "NO"))
                edges.append((p, o, o + k))
    n = spark.createDataFrame(nodes, "prog long, node long, type string, span string")
    return n, spark.createDataFrame(edges, "prog long, src long, dst long")


def test_modes(spark, grove, tmp_path):
    nodes, edges = grove
    engine = Engine(spark, nodes, edges, str(tmp_path / "idioms"), Config(max_size=4, min_size=2))
    assert not engine.status("F")
    one = engine.search("F").collect()
    assert engine.status("F") and one and {r.size for r in one} <= {2, 3, 4} and all(r.nhoods > 0 for r in one)
    assert sorted(engine.search("F").collect()) == sorted(one)  # from its results
    assert {r.size for r in engine.search("F", size=3).collect()} == {3}
    for r in one:  # connected, and with the seed
        m = [int(x) for x in r.members.split(",")]
        assert len(m) == r.size and any((r.prog + x // 64) % 2 and x % 64 == 0 and x for x in m)
    both = engine.run("F;AF", mode="mq").collect()
    assert both and all(r.mode == "mq" and len(r.members.split(",")) == r.size for r in both)
    assert engine.run("nothing").count() == 0
    mined = engine.run("mined", mode="m", trials=5).collect()
    assert mined and {r.mode for r in mined} == {"m"}
    with pytest.raises(ValueError):
        engine.run("F", mode="x")
    assert engine.plot("F").count() == engine.saved("F").count()
    b = engine.benchmark(["F"]).collect()
    assert {r.size for r in b} == {r.size for r in engine.saved("F").collect()}


def test_seeds(spark, grove):
    nodes, edges = grove
    named = labelled(nodes, edges)
    beams = {r.prog: r for r in seeded(named, edges, [[(0, None, "order", "F")], [(0, None, "line", "NO")]]).collect()}
    assert set(beams) == {0, 1, 2, 3}
    for p, r in beams.items():
        assert len(r.members) == 2 and not set(r.members) & set(r.frontier)
    assert 1 <= mining(named, edges, 3).count() <= 3


def test_sampled_subgraphs(spark, small):
    nodes, edges = forest(spark, small)
    near, all_ = defaultdict(set), defaultdict(list)
    for e in edges.collect():
        near[e.prog, e.src].add(e.dst)
        near[e.prog, e.dst].add(e.src)
    for n in nodes.collect():
        all_[n.prog].append(n.node)
    h = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    got = defaultdict(dict)
    for r in graphs.sampled_neighbourhoods(spark, small).collect():
        got[r.prog][r.step] = r.node
    for p, ns in all_.items():
        part = [min(ns, key=lambda n: (h(7, 0, p, n), n))]
        for step in range(1, graphs.STEPS):
            frontier = {y for x in part for y in near[p, x]} - set(part)
            if not frontier:
                break
            part.append(min(frontier, key=lambda n: (h(7, step, p, n), n)))
        assert [got[p][k] for k in range(len(part))] == part and len(got[p]) == len(part)
    pairs = graphs.training_pairs(spark, small).collect()
    for r in pairs:
        q, t = r.query.split(","), r.target.split(",")
        assert len(q) == 3 and len(t) == graphs.STEPS and (r.kind == "pos") == (r.prog == r.target_prog)
        assert r.kind == "neg" or t[:3] == q


def test_principal_axes(spark, small):
    v = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in v], float)
    x -= x.mean(axis=0)
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    got = np.array([(r.x, r.y) for r in graphs.pca_projection(spark, small).collect()])
    assert np.allclose(got.var(axis=0), values[:2], atol=1e-4) and abs(np.cov(got.T)[0, 1]) < 1e-4


CODE = "import numpy as np, os.path\nfrom a.b import c as d, e\nfrom . import z\n\nclass K:\n    pass\n\ndef f(x):\n    return x\n\ny = np.mean(q) + q\ny += r\nif y:\n    w = f(y)\nelse:\n    w = 1\nfor i in w:\n    print(i)\n"


def test_code_scalars():
    assert code.aliases(CODE) == {"numpy": "np", "os.path": "os.path", "a.b.c": "d", "a.b.e": "e"}
    assert code.dropped(CODE).startswith("y = np.mean(q) + q") and "class" not in code.dropped(CODE)
    assert code.normalised("x=( 1 )") == "x = 1" and code.normalised("x=(") is None
    assert code.dummy_function("a = 1\nb = 2") == "def main():\n    a = 1\n    b = 2" and code.dummy_function("") is None
    assert code.masked("y = np.mean(q) + f(a.b)") == "VAR = np.mean(VAR) + f(a.b)"
    assert code.valid_case("assert f(1) == 2") and code.valid_case("x = 1") and not code.valid_case("x = 1", asserting=True) and not code.valid_case("assert (") and not code.valid_case(" ")
    assert (11, "y", "q") in code.computed_from(CODE) and (12, "y", "r") in code.computed_from(CODE)
    assert ("LAST_WRITE", "y", 13, 12) in code.data_flow(CODE) and ("LAST_READ", "q", 11, 11) in code.data_flow(CODE)
    flow = code.control_flow(CODE)
    assert {(13, 14), (13, 16), (14, 17), (16, 17), (17, 18), (18, 17)} <= set(flow)
    assert code.code_tokens("x = 1  # note") == 3 and code.code_tokens("(") is None
    assert code.dot([(0, None, "Module", 'a"b', 0), (1, 0, "Name", "x\ny", 0)]).count("->") == 1
    assert code.highlighted("a < <mark>b</mark>") == "<pre>a &lt; <mark>b</mark></pre>"


def test_parse_checks_over_lines(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = {(r.doc_id, r.k): r for r in catalogue.queries()["code_checks"](spark, small).collect()}
    want = {(d.doc_id, k): line for d in docs for k, line in enumerate((d.text or "").split("\n"))}
    assert got.keys() == want.keys()
    for key, line in want.items():
        r = got[key]
        assert (r.parses, r.valid, r.masked) == (code.parsed(line) is not None, code.valid_case(line), code.masked(line))


def test_files(spark, tmp_path):
    (tmp_path / "src/a/b").mkdir(parents=True)
    for name, text in (("a/x.py", "x = 1\n"), ("a/b/y.py", "y = 2"), ("a/b/n.txt", "no")):
        (tmp_path / "src" / name).write_text(text)
    got = {r.name: r.code for r in files.read_sources(spark, str(tmp_path / "src")).collect()}
    assert got == {"x.py": "x = 1\n", "y.py": "y = 2"}
    df = spark.createDataFrame([(k, k % 3) for k in range(50)], "k long, g long").repartition(7)
    assert [r.idx for r in sorted(files.numbered(df, "g", "k").collect(), key=lambda r: (r.g, r.k))] == list(range(50))
    assert files.numbered(df.limit(0), "k").count() == 0
    once = files.cached(df, str(tmp_path / "kept"))
    assert once.count() == 50 and files.cached(df.limit(1), str(tmp_path / "kept")).count() == 50
    df.createOrReplaceTempView("there")
    assert {r.name: r.there for r in files.indexed(spark, "there", "gone").collect()} == {"there": True, "gone": False}
