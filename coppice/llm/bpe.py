"""Byte-level BPE by speculation: propose tokens by greedy longest match, test every adjacent pair, merge only what fails.

A split of a word into vocabulary entries is the BPE result exactly when each
entry encodes to itself and each adjacent pair of entries, taken alone, encodes
to that pair. The longest-match proposal mostly satisfies this, so one table
lookup per pair confirms it; the rest of the words undergo exact merging.

Texts are cut before every space that precedes a non-space, where the
pre-tokenizer always has a boundary, and each piece is remembered by its
worker. The memory is bounded; when it is full it starts anew.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on which no two versions of Unicode differ; the others are asked for one by one.
PLAIN = re.compile(r"[\n\t\x20-\x7e]*")
#: Beyond so many spaces in a row tiktoken's own pattern fails; the library takes such texts.
LONG = 10_000
_SPACES = re.compile(r"\s{%d}" % LONG)
_RISKY = re.compile(r" (?:\s|$)")
_BEFORE_WORD = re.compile(r" (?=\S)")
PIECES, PAIRS = 200_000, 1 << 20


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Agreed(dict):
    """Whether the library, the pattern here and tiktoken treat a character alike beside letters, digits, marks and spaces; found out once a character."""

    def __init__(self, bpe: ByteBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, c: str) -> bool:
        bpe, same = self.bpe, unicodedata.category(c) != "Cn"
        for probe in (f"a{c}a", f"1{c}1", f"!{c}!", f" {c} {c}{c}a", f"a {c}1"):
            cuts = [probe[a:b] for _, (a, b) in bpe.library.pre_tokenizer.pre_tokenize_str(probe)]
            same = same and cuts == bpe._words(probe) and bpe.library.encode(probe, add_special_tokens=False).ids == bpe.ordinary(probe)
        self[c] = same
        return same


class ByteBPE:
    """speculate: whether words are proposed and verified; else the merges are made one after another. The ids are the same."""

    def __init__(self, path: str, pieces: int = PIECES, speculate: bool = True):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in self.special and all(c in letters for c in t)}
        self.token_bytes: list[bytes] = [b""] * (1 + max([*self.ranks.values(), *self.special.values()]))
        for b, i in self.ranks.items():
            self.token_bytes[i] = b
        for t, i in self.special.items():
            self.token_bytes[i] = t.encode()
        self._check_ranks(spec["model"]["merges"], vocab)
        merging = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self._merge, self.ordinary = merging._core_bpe.encode_single_piece, merging._core_bpe.encode_ordinary
        self.agreed, self.speculate = _Agreed(self), speculate
        self._words = regex.compile(PATTERN).findall
        self._split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.limit = pieces
        self.known: dict[str, bytes] = {}
        self.proposed = self.failed = 0
        if not speculate:
            return
        self._longest = ahocorasick.Automaton()
        for b, i in self.ranks.items():
            if self._merge(b) == [i] and self._stable(b):
                self._longest.add_word(b.decode("latin-1"), i << 10 | len(b))
        for b in range(256):
            self._longest.add_word(bytes([b]).decode("latin-1"), self.ranks[bytes([b])] << 10 | 1)
        self._longest.add_word("Ā", -1)  # between words
        self._longest.make_automaton()
        self._pair_key = np.full(PAIRS, -1, np.int64)
        self._pair_ok = np.zeros(PAIRS, bool)

    @staticmethod
    def _check_ranks(merges: list, vocab: dict[str, int]) -> None:
        """Ids must grow in the order of merges, so that the lowest id is the first merge."""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        made = [vocab[a + b] for a, b in pairs]
        if any(x >= y for x, y in zip(made, made[1:], strict=False)):
            raise ValueError("token ids do not follow the order of merges")

    def _stable(self, b: bytes) -> bool:
        return len(b) == 1 or self.merge(b) == [self.ranks[b]]

    def merge(self, word: bytes) -> list[int]:
        """Exact merging without the shortcut for words that are vocabulary entries."""
        if len(word) > 400:
            return list(self._merge(word))
        parts = [word[k : k + 1] for k in range(len(word))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = 1 << 60, -1
            for k in range(len(parts) - 1):
                r = ranks.get(parts[k] + parts[k + 1])
                if r is not None and r < best:
                    best, at = r, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of token ids: do the joined bytes encode to that pair? Answers are kept in a direct-mapped table."""
        key = a.astype(np.int64) << 20 | b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIRS.bit_length() + 1)).astype(np.int64)
        ok = self._pair_ok[slot]
        new = np.flatnonzero(self._pair_key[slot] != key)
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            tb, merge = self.token_bytes, self._merge
            found = np.fromiter((merge(tb[x] + tb[y]) == [x, y] for x, y in zip((fresh >> 20).tolist(), (fresh & 0xFFFFF).tolist(), strict=True)), bool, len(fresh))
            ok[new] = found[back]
            self._pair_key[slot[new]] = key[new]
            kept = new[self._pair_key[slot[new]] == key[new]]  # of pairs that share a slot one stays
            self._pair_ok[slot[kept]] = ok[kept]
        return ok

    def words(self, words: list[bytes]) -> list[bytes]:
        """Token ids of pre-tokenized words, each as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        found = [v for _, v in self._longest.iter_long("Ā".join([w.decode("latin-1") for w in words]))]
        value = np.array(found, np.int64)
        width, value = value & 1023, value >> 10
        cuts = np.flatnonzero(value < 0)
        starts, ends = np.r_[0, cuts + 1], np.r_[cuts, len(value)]
        inner = np.flatnonzero((value[:-1] >= 0) & (value[1:] >= 0)) if len(value) > 1 else np.zeros(0, np.int64)
        bad = np.zeros(len(words), bool)
        which = np.cumsum(value < 0)
        if len(inner):
            bad[which[inner[~self._compatible(value[inner], value[inner + 1])]]] = True
        # A proposal must also cover its word.
        covered = np.bincount(which[value >= 0], weights=width[value >= 0], minlength=len(words)) if len(value) else np.zeros(len(words))
        bad |= covered != np.fromiter(map(len, words), np.int64, len(words))
        ids = value.astype("<u4")
        out = [ids[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        for k in np.flatnonzero(bad).tolist():
            out[k] = array("I", self._merge(words[k])).tobytes()
        self.proposed += len(words)
        self.failed += int(bad.sum())
        return out

    def _learn(self, missing: list[str]) -> None:
        """Encode pieces that this worker hasn't met."""
        known, agreed = self.known, self.agreed.__getitem__
        single, several = [], []
        for p in missing:
            if not PLAIN.fullmatch(p) and not all(map(agreed, p)):
                known[p] = array("I", self.library.encode(p, add_special_tokens=False).ids).tobytes()
            elif p[1:].isalpha() and (p[0] == " " or p[0].isalpha()):
                single.append(p)
            elif p[-1] in ".,;:!?" and p[1:-1].isalpha() and (p[0] == " " or p[0].isalpha()):
                several.append((p, (p[:-1], p[-1])))  # as the pattern splits it
            else:
                several.append((p, self._words(p)))
        fresh = [w for w in dict.fromkeys([*single, *(w for _, ws in several for w in ws)]) if w not in known]
        got = dict(zip(fresh, self.words([w.encode() for w in fresh]), strict=True))
        for p in single:
            known[p] = got[p] if p in got else known[p]
        for p, ws in several:
            known[p] = b"".join([got[w] if w in got else known[w] for w in ws])

    def _merged(self, text: str) -> bytes:
        """Ids of a text by merging alone; nothing is remembered."""
        if not all(map(self.agreed.__getitem__, set(text))) or len(text) > LONG and _SPACES.search(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if any(s in text for s in self.special):
            return b"".join(np.array([self.special[x]], "<u4").tobytes() if k % 2 else array("I", self.ordinary(x)).tobytes() for k, x in enumerate(self._split_special.split(text)))
        return array("I", self.ordinary(text)).tobytes()

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Cut before each space that precedes a non-space; the space goes with what follows."""
        if _RISKY.search(text):
            first, *rest = _BEFORE_WORD.split(text)
            return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]
        return text.replace(" ", "\x00 ").split("\x00") if "\x00" not in text else ["".join(x) for x in re.findall(r" ?[^ ]+", text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers; special strings inside texts are special tokens."""
        if not self.speculate:
            return list(map(self._merged, texts))
        known = self.known
        out: list[bytes] = []
        todo: list[list[str]] = []
        missing: set[str] = set()
        for t in texts:
            ps = self.pieces(t) if not any(s in t for s in self.special) else [x for k, part in enumerate(self._split_special.split(t)) for x in ([f"\ud800{part}"] if k % 2 else self.pieces(part))]
            todo.append(ps)
            missing.update(ps)
        missing = {p for p in missing if p not in known}
        missing.discard("")
        if len(known) + len(missing) > self.limit:
            known.clear()
            missing = {p for ps in todo for p in ps} - {""}
        known[""] = b""
        for s, i in self.special.items():
            known[f"\ud800{s}"] = np.array([i], "<u4").tobytes()
            missing.discard(f"\ud800{s}")
        if missing:
            self._learn(list(missing))
        get = known.__getitem__
        for ps in todo:
            out.append(b"".join(map(get, ps)))
        return out

    def decode(self, ids: bytes) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def byte_bpe(path: str, speculate: bool = True) -> ByteBPE:
    """One encoder, with its memory of pieces, per worker process; with another vocabulary or way the former one goes."""
    return ByteBPE(path, speculate=speculate)
