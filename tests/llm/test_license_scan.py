"""The licence scan against brute force: every unit against every template."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from coppice.llm import licenses  # noqa: E402

LISTED = tuple(licenses.TEMPLATES)
SEEDS = licenses.seeds(LISTED, licenses.THRESHOLD)
VOTES = licenses.votes(LISTED, SEEDS)
MIT = next(x for n, x in LISTED if n == "MIT" and len(x) > 900)
GPL = next(x for n, x in LISTED if n == "GPL-3.0" and len(x) > 400)


def wrapped(text, mark, width=9):
    w = text.split(" ")
    return "\n".join(mark + " ".join(w[k : k + width]) for k in range(0, len(w), width))


TEXTS = [
    None, "", " \n ", "no licence here", "license", "licensed under",
    "/*\n" + wrapped(MIT, " * ") + "\n */\nint main() {}",
    wrapped(GPL, "# ") + "\nimport this",
    wrapped(GPL, "// ", 5) + "\n//\n" + wrapped(MIT, "// ", 14),
    "Foo bar. Released under the MIT License. More text follows here.",
    "code(); // Licensed under the Apache License, Version 2.0.\nmore();",
    "intro words before " + MIT + " and words after it " * 3,
    "Permission is hereby granted, free of charge, to \x01 any person obtaining a copy of this software",
    "This work is LICENSED under the GNU Affero General Public License, version 3!",
    MIT.replace("Software", "Program"), MIT[: len(MIT) // 2], ("word " * 3000) + "Licensed under CC BY-SA 4.0. " + "other " * 3000,
    *(x for _, x in LISTED),
]


def agree(spark, texts):
    docs = spark.createDataFrame([(k, t, "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, _t string, _w int")
    got = {r.doc_id: r for r in licenses.scan(spark, docs).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        want = brute.licenses(t, LISTED, licenses.THRESHOLD, SEEDS, VOTES)
        r = got[k]
        if not want:
            assert (r.n_units, r.license, r.score, r.licenses) == (0, None, 0, ""), t
        else:
            top = max(want.values())
            assert (r.n_units, r.license, r.score) == (len(want), LISTED[-top[1]][0], top[0]), t
            assert r.licenses == ",".join(sorted({LISTED[-x[1]][0] for x in want.values()})), t
    return got


def test_hard_texts(spark):
    got = agree(spark, TEXTS)
    assert (got[6].license, got[6].score) == ("MIT", 1000) and (got[7].license, got[7].score) == ("GPL-3.0", 1000)
    assert [got[len(TEXTS) - len(LISTED) + k].score for k in range(len(LISTED))] == [1000] * len(LISTED)


def test_documents(spark, small):
    agree(spark, [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()])


def test_empty_nulls_repeats(spark):
    docs = spark.createDataFrame([(None, LISTED[0][1]), (1, LISTED[0][1]), (1, LISTED[0][1]), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.score) for r in licenses.scan(spark, docs).collect()) == [(0, 1000), (1, 1000), (1, 1000), (2, 0)]
    assert licenses.scan(spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("t", [0.6, 0.8, 0.95])
def test_anchors_lose_nothing(t):
    of = licenses.anchors(LISTED, t)
    for _, x in LISTED:
        b = licenses.bigrams(x)
        assert sum(not set(g.split()) & set(of) for g in b) < licenses.least_shared(len(b), t)
