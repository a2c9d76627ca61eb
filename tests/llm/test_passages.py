"""Passages counted in words, against brute force: those of over 50 words may have fewer than 400 bytes."""

import sys
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from coppice.llm import queries, suffixes  # noqa: E402


def passages(texts, words):
    """(n_passages, n_passage_words) of each text."""
    split = [(t or "").encode().split() for t in texts]
    windows = Counter(tuple(w[k : k + words]) for w in split for k in range(len(w) - words + 1))
    out = []
    for w in split:
        inside = [False] * len(w)
        for k in range(len(w) - words + 1):
            if windows[tuple(w[k : k + words])] > 1:
                inside[k : k + words] = [True] * words
        out.append((sum(b and not a for a, b in zip([False, *inside], inside)), sum(inside)))
    return out


def check(spark, texts, length, words=51):
    rows = suffixes.report(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length, words=words).collect()
    want = [(k, *b[:4], *p) for k, (b, p) in enumerate(zip(brute.repeats(texts, length), passages(texts, words)))]
    assert sorted(tuple(r) for r in rows) == want
    return want


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 9))) for _ in range(n))


def test_short_passages(spark):
    rng = np.random.default_rng(4)
    said = " ".join(f"w{k}" for k in range(51))
    texts = [
        prose(rng, 9) + " " + said + " " + prose(rng, 70),
        prose(rng, 30) + "\n" + said.replace(" ", " \t\n") + "\x0b" + prose(rng, 5),  # other whitespace
        "x" + said,  # 50 words
        said.rsplit(" ", 1)[0] + " end",
        prose(rng, 200),
        "a " * 52,  # in itself
        "b " * 51,
        None, "", " \n", "é é é " * 20,
    ]
    want = check(spark, texts, 400)
    assert [w[5:] for w in want[:7]] == [(1, 51), (1, 51), (0, 0), (0, 0), (0, 0), (1, 52), (0, 0)]
    assert not any(w[2] for w in want)


def test_over_boundaries(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HEADS", 20)
    monkeypatch.setattr(suffixes, "CORES", 8)
    rng = np.random.default_rng(9)
    hot, other = prose(rng, 120), prose(rng, 70)
    tail = lambda: " ".join(hot.split()[: int(rng.integers(40, 121))])
    texts = [f"{prose(rng, int(rng.integers(1, 60)))} {tail()} {prose(rng, int(rng.integers(1, 60)))}" for _ in range(60)]
    texts += [f"{prose(rng, 5)} {other} {prose(rng, 3)} {hot}", hot, hot, f"{hot} {hot}", "x " * 500, "x " * 52, None, "", other[5:] + "!"] + [texts[0]] * 20
    check(spark, texts, 200)


def test_query(spark, small):
    texts = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    got = queries.op4_suffix_dedup(spark, small)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words"]
    want = [(r.doc_id, *b[:4], *p) for r, b, p in zip(texts, brute.repeats([r.text for r in texts], 400), passages([r.text for r in texts], 51))]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert any(w[6] and not w[2] for w in want)


def test_other_lengths(spark):
    rng = np.random.default_rng(6)
    hot = prose(rng, 90)
    texts = [f"{prose(rng, 9)} {' '.join(hot.split()[int(a) : int(a) + int(n)])} {prose(rng, 9)}" for a, n in rng.integers(5, 45, (40, 2))]
    for words in (8, 17, 30):
        check(spark, texts, 400, words)
