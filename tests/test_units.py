"""Syntax trees, transport cost and components on small inputs."""

import ast
from itertools import permutations

import numpy as np
import pytest

from coppice.functions import sast
from coppice.operators.trees import roots_of
from coppice.operators.vectors import transport


@pytest.mark.parametrize(("code", "want"), [("np.mean", ["#", "#.mean", "np"]), ("os.path.join", ["#", "#.join", "#.path", "os"]), ("train_test_split", ["#", "train_test_split"]), ("g(", []), ("# nothing", [])])
def test_spans(code, want):
    assert [r[3].replace(sast.HOLE, "#") for r in sast.rows_of(code)] == want


@pytest.mark.parametrize("code", ["x = '#'  # note", "def f(a, *b):\n    \"\"\"doc\"\"\"\n    return g(a)[b] + 1", "é = np.max(à); y = f'{x}a'", "@d\ndef f(x):\n    pass", "if a < b < c:\n    print(a, end='')"])
def test_round_trip(code):
    back = sast.code_of(sast.rows_of(code))
    assert ast.dump(ast.parse(back)) == ast.dump(ast.parse(sast.strip_comments(code)))


def test_long_lines_of_words_have_no_tree():
    words = "Orre " * 8000  # Python's parser overflows over these
    assert sast.rows_of(words) == [] and sast.units_of(words) == [] and sast.calls_of(words) == [] and sast.strip_comments(words) == words


@pytest.mark.parametrize("code", ["-" * 2000 + "x", "a" + ".b" * 3000, "1" + "+1" * 3000, "x = " + "not " * 1500 + "y"])
def test_deep_programs_have_trees(code):
    rows = sast.rows_of(code)
    assert len(rows) > 1500 and [r[0] for r in rows] == list(range(len(rows)))
    assert sast.code_of(rows) == code


def test_units_and_calls():
    code = "def b(): pass\nclass A:\n    def a(self): pass\n    def test_a(self): pass\nasync def c(): pass\n"
    assert [n for n, _ in sast.units_of(code)] == ["a", "b"]
    assert "numpy.linalg.inv" in sast.calls_of("import numpy as np\nnp.linalg.inv(x)")


def test_transport_is_the_best_assignment():
    rng = np.random.default_rng(1)
    for n in (1, 2, 4, 5):
        c = rng.random((n, n))
        best = min(sum(c[i, p[i]] for i in range(n)) for p in permutations(range(n))) / n
        assert transport(c) == pytest.approx(best)
    assert transport(np.array([[1.0, 3.0]])) == pytest.approx(2.0)
    assert transport(np.repeat(c, 3, axis=0)) == pytest.approx(best)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)]
    got = {r.id: r.root for r in roots_of(spark, spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
