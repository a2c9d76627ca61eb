"""Null ids, repeated rows, clashing names, texts of a megabyte and empty tables, for each operator and each stage."""

import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from coppice.llm import licenses, minhash, packing, pii, quality, suffixes, token_counts, tokens, topk  # noqa: E402

BYTE, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
LONG = " ".join(f"w{k % 977}x{k // 977}" + (f" mail{k % 7}@a.bc" if k % 50 == 0 else "") for k in range(130_000))  # over a megabyte
COPIED = " ".join(f"copied{k}" for k in range(120))
ROWS = [(None, COPIED), (None, "no id and no other text like this one here at all today"), (1, LONG), (2, COPIED), (2, COPIED), (3, COPIED + " " + LONG[5000:9000]), (4, None), (4, None), (5, ""), (6, "same id, one text of it with some more words here"), (6, "same id, another text of it with some other words")]
#: Names that operators use for columns of their own.
CLASHES = ["_th", "_found", "th", "found", "row", "_row", "_text", "spans", "failed", "n_words", "key", "id", "u", "_gone", "_t", "n", "kept", "n_tokens", "rank", "piece"]
SCHEMA = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in ROWS], SCHEMA).repartition(3)


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def same(got, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_quality(docs):
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.rules(docs).collect()], [(i, *brute.quality(t)) for i, t in ROWS])
    patterns = Counter(r.failed for r in quality.rules(docs).collect())
    for r in quality.ablations(quality.ledger(docs.select("doc_id", "text")), "v2").collect():
        bit = quality.mask([r.rule])
        assert r.n_failed == sum(n for b, n in patterns.items() if b & bit) and r.n_only == patterns[bit] and r.n_kept_without == patterns[0] + patterns[bit]


def test_tokens(docs):
    t, w = library(BYTE), library(WORDS)
    want = []
    for i, x in ROWS:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), brute.hexed(np.array(ids, "<u4").tobytes()), brute.hexed(t.decode(ids, skip_special_tokens=False))))
    same([tuple(r) for r in tokens.digests(docs, BYTE).collect()], want)
    same([(r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs.sparkSession, docs, WORDS).collect()], [(i, len((x or "").encode()), len(w.encode(x or "", add_special_tokens=False).ids)) for i, x in ROWS])


def test_suffixes(docs):
    want = brute_repeats()
    same([tuple(r) for r in suffixes.report(docs.sparkSession, docs, 400).collect()], [(i, *w[:4]) for (i, _), w in zip(ROWS, want)])
    cut = suffixes.strip(docs.sparkSession, docs, 400)
    assert cut.columns == docs.columns
    same([(r.doc_id, r.text) for r in cut.collect()], [(i, t if t is None else w[4].decode()) for (i, t), w in zip(ROWS, want)])


def brute_repeats():
    """By the whole strings of these rows: the copied text, and what row 3 shares with row 1."""
    texts = [t for _, t in ROWS]
    window = Counter(t.encode()[i : i + 400] for t in texts if t for i in range(len(t.encode()) - 399))
    out = []
    for t in texts:
        d = (t or "").encode()
        hit = np.zeros(len(d) + 1, np.int64)
        for i in range(len(d) - 399):
            if window[d[i : i + 400]] > 1:
                hit[i] += 1
                hit[i + 400] -= 1
        gone = np.cumsum(hit[:-1]) > 0
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((len(d), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), brute.hexed(kept), kept))
    return out


def test_near(docs):
    sets = [(i, brute.shingles(t, 5)) for i, t in ROWS]
    like = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)
    root = {i: i for i, _ in sets if i is not None}
    for _ in root:
        for a, x in sets:
            for b, y in sets:
                if a is not None and b is not None and like(x, y):
                    root[a] = root[b] = min(root[a], root[b])
    got = minhash.duplicates(docs.sparkSession, docs, 5, 80).collect()
    same([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got], [(i, len(s), root.get(i), i is None or root[i] == i) for i, s in sets])
    left = minhash.deduplicate(docs.sparkSession, docs, 5, 80)
    assert left.columns == docs.columns
    same([(r.doc_id, r.text) for r in left.collect()], [(i, t) for i, t in ROWS if i is None or root[i] == i])


def test_packing(docs):
    t = library(BYTE)
    want = Counter()
    for i, x in ROWS:
        ids, at, k = [*t.encode(x or "", add_special_tokens=False).ids, 2], 0, 0
        first = (len(ids) - 1) % 1024 + 1
        while at < len(ids):
            n = first if k == 0 else 1024
            want[i, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at, k = at + n, k + 1
    rows = packing.pack(docs.sparkSession, docs, BYTE).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for s in places.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024


def test_licenses_and_personal_data(docs):
    assert docs.count() == licenses.scan(docs.sparkSession, docs).count()
    names = ["email", "ip", "card", "phone"]
    want = [(i, brute.hexed(",".join(f"{names[k]}:{a}:{b}" for a, k, b in brute.pii(t)))) for i, t in ROWS]
    same([(r.doc_id, r.base_sha256) for r in pii.report(docs).collect()], want)
    hidden = pii.redact(docs)
    assert hidden.columns == docs.columns and not any("@a.bc" in (r.text or "") for r in hidden.collect())


def test_topk_clashes(spark):
    rows = [(k, [float(k % 5), 1.0]) for k in range(60)] + [(50, [4.0, 1.0]), (None, [9.0, 1.0]), ((1 << 63) - 1, [9.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, key int, v int, score int")
    got = [tuple(r) for r in topk.search(spark, df, "vec_id % 50 = 0").collect()]
    key = lambda r: (r[0], r[1], r[2] is None, r[2] or 0, r[3])
    assert sorted(got, key=key) == sorted(brute.topk(rows, 50), key=key)
    assert any(r[2] == (1 << 63) - 1 for r in got) and any(r[2] is None for r in got)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("which", ["hard", "empty"])
def test_stages(spark, small, docs, name, which):
    stage = dict(corpus_pipeline.STAGES)[name]
    full = docs.selectExpr("*", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars")
    given = full if which == "hard" else full.limit(0)
    out = stage(spark, given, small)
    rows = out.collect()
    if name != "packing":
        assert out.columns == given.columns
    if which == "empty":
        assert not rows
    elif name == "quality_rules":
        same([(r.doc_id, r.text) for r in rows], [(i, t) for i, t in ROWS if not brute.quality(t)[-1] and (i, t) in {(r.doc_id, r.text) for r in rows}])
        assert {r.doc_id for r in rows} >= {None, 2, 3}
    elif name == "near_dedup":
        assert {r.doc_id for r in rows} >= {None, 1, 2, 4, 5, 6}
    elif name in ("suffix_dedup", "pii"):
        assert len(rows) == len(ROWS) and all(r.n_chars == (len(r.text) if r.text is not None else None) for r in rows)
    else:
        assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
