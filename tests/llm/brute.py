"""The operators' contracts, computed one document or pair at a time."""

import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def hexed(x):
    return sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    t = text or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    rep = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)


def topk(rows, every, k=5):
    """rows: (vec_id, vector)"""
    ok = [(i, np.floor(256 * np.array(v, float)).astype(object)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(ok):
        if q is None or q % every:
            continue
        got = []
        for b, (c, y) in enumerate(ok):
            if a != b:
                n = min(len(x), len(y))
                got.append((-int(sum(x[:n] * y[:n])), c is None, c))
        out += [(q, r + 1, c, -s) for r, (s, _, c) in enumerate(sorted(got, key=lambda g: (g[0], g[1], g[2] or 0))[:k])]
    return out


def repeats(texts, length):
    """n_bytes, n_removed, n_spans, kept_sha256, kept for each text"""
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if n[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), hexed(kept), kept))
    return out


def shingles(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near(docs, k, percent):
    """docs: (doc_id, text) with distinct ids. doc_id: (n_shingles, component)"""
    sets = {i: shingles(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holds = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holds[g].append(i)
    both = Counter()
    for ids in holds.values():
        for a in range(len(ids)):
            for b in range(a):
                both[ids[b], ids[a]] += 1
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def pii(text):
    """The base spans: (start, kind, end)"""
    t = text or ""
    digits = lambda x: re.sub("[^0-9]", "", x)
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(digits(x)) <= 19 and luhn(digits(x))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m[0]))


def escaped(t):
    return re.sub(r"<(\\*)\|", lambda m: "<" + m[1] + "\\|", t)


def chat(rows):
    """rows: (conv_id, turn, role, text). conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)"""
    by = defaultdict(list)
    for c, k, r, t in rows:
        by[c].append((k, r or "", t or ""))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        chars = sum(len(f"<|im_start|>{escaped(r.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n{escaped(t)}<|im_end|>\n") for _, r, t in turns)
        out[c] = (len(turns), hexed("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), hexed(loss), chars)
    return out


def licenses(text, listed, threshold, seeds, votes):
    """Scores of the units that match: {words of the unit: (thousandths, -template)}. seeds: bigram to (template, offset)."""
    fold = lambda x: re.sub(r"[^a-z0-9]+", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)).split()
    t = text or ""
    lines = t.split("\n")
    units = {tuple(fold(s)) for x in lines for s in re.split(r"(?<=[.!?:;])[\x20\t]+", x)} | {tuple(fold(x)) for x in lines} | {tuple(fold(t))}
    block: list = []
    for x in [*lines, ""]:
        if fold(x):
            block += fold(x)
        else:
            units.add(tuple(block))
            block = []
    known, w = [fold(x) for _, x in listed], fold(t)
    got = Counter((k, i - off) for i, (a, b) in enumerate(zip(w, w[1:])) for k, off in seeds.get(f"{a} {b}", ()))
    units |= {tuple(w[max(0, i) : i + len(known[k])]) for (k, i), n in got.items() if n >= votes[k]}
    out = {}
    pairs = lambda x: set(zip(x, x[1:]))
    for u in units:
        mine = pairs(u)
        scored = [(2000 * len(mine & p) // (len(mine) + len(p)), -k) for k, x in enumerate(known) if (p := pairs(x)) and mine and len(mine & p) * 2 >= threshold * (len(mine) + len(p)) - 1e-9]
        if scored:
            out[u] = max(scored)
    return out
