"""Operators against brute force: hard rows, empty tables, and the smallest tables whole."""

import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from coppice.llm import chat, licenses, minhash, packing, pii, quality, queries, suffixes, token_counts, tokens, topk  # noqa: E402

BYTE, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
PASSAGE = " ".join(f"wörd{k}" for k in range(80))
HARD = [None, "", "   \n\t ", "one", "one two three four five six seven eight nine ten", "a b c d e " * 12, PASSAGE, PASSAGE + " end", "x" + PASSAGE, PASSAGE, "x" * 3000, "ab " * 5000, "line one\nline one\n\nline\tone\r\nline one", "<|endoftext|> hi<|im_end|>", "  lead  and   trail  ", "naïve 漢字 🙂 e\u0301 \x00 \u2028 don't we'll",
        "mail a.b@c.d.e_x@y.z 1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 4111 1111 1111 1111 +49 (30) 1234-5678 +1 23", "iban DE89 3704 0044 0532 0130 00 ssn: 123-45-6789 token=" + "0f" * 20, "Released under the MIT License. More."]
SCHEMA = "doc_id long, text string, n_words long, spans string, key int, failed string, _row int"


def frame(spark, texts):
    return spark.createDataFrame([(k, t, 7, "s", 1, "f", 2) for k, t in enumerate(texts)], SCHEMA)


def lib(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def tables(spark, small):
    docs = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]
    return {"hard": HARD, "empty": [], "small": docs}


@pytest.mark.parametrize("which", ["hard", "empty", "small"])
def test_quality(spark, tables, which):
    docs = frame(spark, tables[which])
    got = {r.doc_id: r for r in quality.rules(docs).collect()}
    for k, t in enumerate(tables[which]):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(t)
        assert not (r.kept and r.base_failed)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.kept}
    a = {r.rule: r for r in quality.ablations(quality.ledger(docs.select("doc_id", "text")), "v2").collect()}
    for k, rule in enumerate(quality.RULES):
        if got:
            assert a[rule].n_failed == sum(bool(r.failed >> k & 1) for r in got.values())


def test_topk(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(120)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 8), (250, []), (251, [1.0] * 9), (252, [3e6] * 8), (253, rows[0][1]), (0, rows[0][1]), (None, [2.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumnRenamed("x", "score")
    got = [tuple(r) for r in topk.search(spark, df, "vec_id % 50 = 0").collect()]
    key = lambda r: (r[0], r[1], r[2] is None, r[2] or 0, r[3])
    assert sorted(got, key=key) == sorted(brute.topk(rows, 50), key=key)
    assert topk.search(spark, df.limit(0), "vec_id % 50 = 0").count() == 0


@pytest.mark.parametrize("which", ["hard", "empty", "small"])
def test_tokens(spark, tables, which):
    texts, t, w = tables[which], lib(BYTE), lib(WORDS)
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in tokens.digests(docs, BYTE).collect()}
    counts = {r.doc_id: r for r in token_counts.count_tokens(spark, docs, WORDS).collect()}
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(docs, BYTE), BYTE).collect()}
    for k, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert (got[k].n_tokens, got[k].ids_sha256) == (len(ids), brute.hexed(np.array(ids, "<u4").tobytes()))
        assert got[k].decoded_sha256 == brute.hexed(back[k]) == brute.hexed(t.decode(ids, skip_special_tokens=False))
        assert (counts[k].n_bytes, counts[k].n_tokens) == (len((x or "").encode()), len(w.encode(x or "", add_special_tokens=False).ids))


@pytest.mark.parametrize("which", ["hard", "empty", "small"])
def test_suffixes(spark, tables, which):
    texts = tables[which]
    docs = frame(spark, texts)
    want = brute.repeats(texts, 400)
    got = {r.doc_id: r for r in suffixes.report(spark, docs, 400).collect()}
    assert {k: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for k, r in got.items()} == {k: w[:4] for k, w in enumerate(want)}
    cut = suffixes.strip(spark, docs, 400)
    assert cut.columns == docs.columns
    for r in cut.collect():
        assert r.text is None if texts[r.doc_id] is None else len(r.text.encode()) >= len(want[r.doc_id][4])


@pytest.mark.parametrize("k", [4, 5])
@pytest.mark.parametrize("which", ["hard", "empty", "small"])
def test_near(spark, tables, which, k):
    texts = tables[which]
    docs = frame(spark, texts)
    want = brute.near(list(enumerate(texts)), k, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.duplicates(spark, docs, k, 80).collect()} == want
    assert sorted(r.doc_id for r in minhash.deduplicate(spark, docs, k, 80).collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_near_chain_and_repeated_rows(spark):
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base[:k] + ["new" + str(k)] + base[k + 1 :]) for k in range(0, 100, 9)]
    rows = [(i, t) for i, t in enumerate(texts)]
    want = brute.near(rows, 4, 80)
    docs = spark.createDataFrame([*rows, rows[0], (None, texts[1])], "doc_id long, text string")
    got = [r for r in minhash.duplicates(spark, docs, 4, 80).collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_chat(spark, small):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()]
    rows += [(900, 0, "user", "a<|b"), (900, 1, "assistant", None), (900, 1, "assistant", r"<\|c<\\|"), (901, 0, "user", "a<|b"), (902, 0, "user", "a<|b"), (902, 1, "assistant", "x"), (903, 0, "ro\nle\\n<|", ""), (903, None, None, "<|endoftext|>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, node int")
    want = brute.chat([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.report(spark, df, BYTE).collect()}
    assert got == want
    nodes, runs, paths = chat.prefix_tree(spark, df, BYTE)
    node, run = {r.node: r for r in nodes.collect()}, {r.run: r for r in runs.collect()}
    assert sum(r.n_tokens for r in node.values()) == sum(r.length for r in run.values())
    at = 0
    for r in sorted(run.values(), key=lambda r: r.start):  # gapless
        assert r.start == at
        at += r.length
    for r in run.values():  # a run sees its ancestors' tokens, one for each position before it
        seen = [x for a in r.attends for x in range(a.lo, a.hi)]
        assert len(seen) == r.position == len(set(seen))
    assert paths.count() == len(rows)
    assert chat.report(spark, df.limit(0), BYTE).count() == 1


@pytest.mark.parametrize("which", ["hard", "empty", "small"])
def test_packing(spark, tables, which):
    texts, t = tables[which], lib(BYTE)
    rows = packing.pack(spark, frame(spark, texts), BYTE, 1024, 2).collect()
    total = 0
    for k, x in enumerate(texts):
        ids, at = [*t.encode(x or "", add_special_tokens=False).ids, 2], 0
        for i, p in enumerate(sorted((r for r in rows if r.doc_id == k), key=lambda r: r.piece)):
            assert (p.piece, p.start) == (i, at) and p.length <= 1024 and (i == 0 or p.length == 1024)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
        total += at
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    assert len(seqs) <= 1.02 * total / 1024 + 2


def test_license(spark):
    got = {r.doc_id: r for r in licenses.scan(spark, frame(spark, HARD)).collect()}
    assert got[len(HARD) - 1].license == "MIT" and got[len(HARD) - 1].score == 1000
    assert sum(r.n_units > 0 for r in got.values()) == 1
    def dice(a, b):
        return int(2000 * len(set(a) & set(b)) / (len(a) + len(b)))
    text = "Licensed under the Apache Licence, Version 2.0."
    want = max(dice(licenses.bigrams(text), licenses.bigrams(t)) for _, t in licenses.TEMPLATES)
    r = licenses.scan(spark, frame(spark, [text])).first()
    assert (r.n_units > 0) == (want >= 800) and r.score in (0, want)
    assert licenses.scan(spark, frame(spark, [])).count() == 0


@pytest.mark.parametrize("which", ["hard", "empty", "small"])
def test_pii(spark, tables, which):
    texts = tables[which]
    docs = frame(spark, texts)
    names = ["email", "ip", "card", "phone"]
    for r in pii.report(docs).collect():
        want = brute.pii(texts[r.doc_id])
        assert r.base_sha256 == brute.hexed(",".join(f"{names[k]}:{a}:{b}" for a, k, b in want))
        n = Counter(k for _, k, _ in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in range(4))
        assert {f"{names[k]}:{a}:{b}" for a, k, b in want} <= set(r.spans.split(","))
    hidden = pii.redact(docs)
    assert hidden.columns == docs.columns
    for r in hidden.collect():
        t = texts[r.doc_id]
        assert r.text == t if not brute.pii(t) and "iban" not in (t or "") and r.spans == "s" and "[" not in (r.text or "") else r.text != t or "[" in t


def test_pipeline(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            rows = docs.collect()
            assert all(r.n_chars == len(r.text or "") for r in rows if r.text is not None)
            after = {r.doc_id: r.text for r in rows}
        if name == "quality_rules":
            assert after.keys() <= texts.keys() and not any(brute.quality(t)[-1] for t in after.values())
        if name == "near_dedup":
            assert set(after) == {i for i, (_, c) in brute.near(list(before.items()), 5, 80).items() if i == c}
        if name == "suffix_dedup":
            want = dict(zip(before, brute.repeats(list(before.values()), corpus_pipeline.PASSAGE), strict=True))
            assert all((after[i] == t) == (want[i][1] == 0) for i, t in before.items())
        if name == "pii":
            assert not any(brute.pii(t) for t in after.values())
    assert {r.doc_id for r in docs.collect()} == set(after)


def test_all_are_registered():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{k}" for k in range(1, 11)}


def test_near_in_many_cells(spark, monkeypatch):
    """A hot group with pairs on both sides of the threshold, in cells far smaller than the group, against all pairs."""
    monkeypatch.setattr(minhash, "SIDE", 8)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(240):
        w = list(base)
        for k in rng.choice(60, rng.integers(0, 4), replace=False):
            w[k] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute.near(list(enumerate(texts)), 4, 80)
    assert 1 < len({c for _, c in want.values()}) < 240
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.duplicates(spark, docs, 4, 80).collect()} == want


def test_suffixes_over_boundaries(spark, monkeypatch):
    """Buckets far smaller than the groups of passages, copies and near copies: what meets only across boundaries is found."""
    monkeypatch.setattr(suffixes, "HEADS", 20)
    monkeypatch.setattr(suffixes, "CORES", 8)
    rng = np.random.default_rng(9)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 9))) for _ in range(n))
    hot, other = prose(90), prose(70)
    texts = [prose(int(rng.integers(0, 40))) + hot[: int(rng.integers(300, len(hot)))] + prose(int(rng.integers(0, 40))) for _ in range(60)]
    texts += [prose(5) + other + prose(3) + hot, hot, hot, hot + hot, "x" * 1500, "x" * 401, None, "", other[5:] + "!"] + [texts[0]] * 20
    want = brute.repeats(texts, 200)
    got = {r.doc_id: r for r in suffixes.report(spark, frame(spark, texts), 200).collect()}
    assert {k: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for k, r in got.items()} == {k: w[:4] for k, w in enumerate(want)}


def test_multikey_sort():
    rng = np.random.default_rng(1)
    tokens = [rng.integers(0, 3, 500) for _ in range(6)]
    order, shared = suffixes.multikey_sort(tokens)
    rows = list(zip(*(t.tolist() for t in tokens)))
    assert [rows[k] for k in order] == sorted(rows)
    for k in range(1, len(rows)):
        a, b = rows[order[k - 1]], rows[order[k]]
        assert shared[k] == next((i for i in range(6) if a[i] != b[i]), 6)
    assert shared[0] == 0
