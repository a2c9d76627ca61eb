"""Token counts by a two-tier lookup on the map side (operator 5).

A piece is what stands between spaces and line feeds: mostly one pre-token, or one
with punctuation. The first tier is one compact table of the corpus' frequent
pieces and pre-tokens with their token counts, broadcast; it has FREQUENT entries
of at most WIDTH characters at most. The second tier is each worker's bounded
cache: a piece that misses the table is cut into its pre-tokens, and what of these
misses too is merged. Both tiers only save work, no count rests on them.

The table is found by heavy-hitter sketches of all documents: every task keeps
bounded counts and sends one sketch of PER_TASK entries, MERGERS tasks merge the
sketches they get, and the driver the MERGERS results. Pre-tokens are no rows of a
shuffle; a sketch is some 50 KB a task, whatever the task has read.

A word's merges depend on nothing outside it. Where the vocabulary is byte-level
with word ends, tiktoken's merging gives the library's tokens: a word end is a byte
that no text has, and the entries of one letter with a word end are the first
merges. That is so if every entry merges to itself, which is checked; otherwise,
and for characters on which versions of Unicode may differ, the library counts.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .arrow import slices, texts
from .bpe import _byte_letters

FREQUENT, PER_TASK, WIDTH, CACHED, MERGERS = 32_768, 4_096, 24, 300_000, 64
#: Counters larger than this drop their rarest entries; what is dropped is only encoded by a worker instead of looked up.
COUNTED = 100_000
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = b"\xff"


def _pieces(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


def _ranks(spec: dict) -> dict[bytes, int]:
    letters, ends, special = _byte_letters(), "</w>", {t["content"] for t in spec["added_tokens"]}
    return {bytes(letters[c] for c in t.removesuffix(ends)) + (END if t.endswith(ends) else b""): i for t, i in spec["model"]["vocab"].items() if t not in special}


def word_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as bytes, END for a word end; None if the file isn't of the kind that the module's text names."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    known = len(pre) == 2 and pre[0].get("pattern") == {"Regex": PATTERN} and pre[0].get("invert") and pre[0].get("behavior") == "Removed" and pre[1]["type"] == "ByteLevel" and not pre[1]["use_regex"] and not pre[1]["add_prefix_space"]
    if not known or steps != ["NFC", "Replace", "Lowercase"] or model.get("end_of_word_suffix") != "</w>" or model.get("ignore_merges") or spec.get("post_processor"):
        return None
    ranks = _ranks(spec)
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    first = {bytes([b]) + END for b in range(255)}
    if any(x >= y for x, y in zip(made, made[1:], strict=False)) or any(ranks.get(x, made[0]) >= made[0] for x in first):
        return None
    return ranks if all(_itself(t, ranks) for t in ranks) else None


def _itself(token: bytes, ranks: dict[bytes, int]) -> bool:
    """Whether an entry's letters merge to the entry."""
    end = token[-1:] == END and len(token) > 1
    parts = [token[k : k + 1] for k in range(len(token) - end)]
    if end:
        parts[-1] += END
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda k: ranks.get(parts[k] + parts[k + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            return False
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts == [token]


@lru_cache(maxsize=4)
def mergeable(path: str) -> bool:
    """Found out on the driver, once a vocabulary."""
    return path.endswith(".json") and word_ranks(path) is not None


class Counts:
    """Token counts of one tokenizer; `frequent` is shared, `cache` is this worker's own."""

    def __init__(self, path: str, frequent: dict[str, int], merges: bool):
        self.frequent, self.cache, self.path = frequent, {}, path
        self.by_piece = False
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.by_piece = splits_at_spaces(path)
        self.merge = None
        if merges:
            import tiktoken

            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.special = [x["content"] for x in spec["added_tokens"]]
            self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=_ranks(spec), special_tokens={})._core_bpe.encode_single_piece
            self.words = regex.compile(PATTERN + r"|\n").findall
            self.agreed: dict[str, bool] = {}

    def _library(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch(pieces, add_special_tokens=False)]

    def _own(self, pieces: list[str]) -> list[int]:
        """Tokens of pieces without line feeds: all are cut in one pass, and each pre-token that misses the table is merged once."""
        words = self.words("\n".join([*pieces, ""]).lower())
        known = {w: self.frequent.get(w) or len(self.merge(w.encode() + END)) for w in set(words)}
        known["\n"] = 0
        out, total = [], 0
        for w in words:
            total += known[w]
            if w == "\n":
                out.append(total)
                total = 0
        return out

    def _agreed(self, c: str) -> bool:
        """Whether a character is treated as the library treats it; found out once. Lowering of a sigma depends on what follows."""
        if c not in self.agreed:
            probes = [c, f"a{c}a", f"1{c}1", f"!{c}!", f"{c}{c}a"]
            self.agreed[c] = unicodedata.category(c) != "Cn" and c not in "\n\u03a3" and self._library(probes) == self._own(probes)
        return self.agreed[c]

    def _mine(self, p: str) -> bool:
        if p.isascii() and p.isprintable():
            return "<|" not in p or not any(s in p for s in self.special)
        return all(map(self._agreed, p)) and unicodedata.is_normalized("NFC", p) and not any(s in p for s in self.special)

    def lengths(self, pieces: list[str]) -> list[int]:
        if self.merge is None:
            return self._library(pieces)
        mine = [self._mine(p) for p in pieces]
        own, rest = iter(self._own([p for p, m in zip(pieces, mine, strict=True) if m])), [p for p, m in zip(pieces, mine, strict=True) if not m]
        library = iter(self._library(rest) if rest else [])
        return [next(own) if m else next(library) for m in mine]

    def __call__(self, batch: list[str]) -> list[int]:
        if not self.by_piece:
            return self._library(batch) if hasattr(self, "library") else [len(x) for x in self.model.encode(batch, num_threads=1)]
        cut = [_pieces(t) for t in batch]
        cache, known = self.cache, self.frequent
        missing = [p for p in {p for ps in cut for p in ps} if p not in cache and p not in known]
        if len(cache) + len(missing) > CACHED + len(known):
            cache.clear()
        if not cache:
            cache.update(known)
            missing = [p for p in {p for ps in cut for p in ps} if p not in cache]
        for k in range(0, len(missing), 4096):
            part = missing[k : k + 4096]
            cache.update(zip(part, self.lengths(part), strict=True))
        get = cache.__getitem__
        return [sum(map(get, ps)) for ps in cut]


def splits_at_spaces(path: str) -> bool:
    """Whether cutting a text at spaces and line feeds leaves its tokens as they are: the pre-tokenizer drops white space and nothing before it joins across."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    drops = pre[0].get("type") == "Split" and pre[0].get("behavior") == "Removed" and pre[0].get("invert") is True and r"\s" in str(pre[0]["pattern"]) and "?!" not in str(pre[0]["pattern"]) and not any(p.get("add_prefix_space") or p.get("use_regex") for p in pre[1:])
    calm = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " " for n in (spec.get("normalizer") or {}).get("normalizers", []))
    return drops and calm and not spec.get("post_processor") and not any(set(t["content"]) & set(" \n") or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])


def _sketched(seen: Counter[str]) -> pa.RecordBatch:
    top = [(p, n) for p, n in seen.most_common(PER_TASK) if 0 < len(p) <= WIDTH and n > 1]
    return pa.RecordBatch.from_arrays([pa.array([json.dumps(top, ensure_ascii=False).encode()], pa.binary())], ["sketch"])


def frequent_pieces(docs: DataFrame) -> list[str]:
    """The corpus' FREQUENT most common pieces, by counts that all tasks keep over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for part in slices(batch):
                for t in texts(part, "text"):
                    seen.update(_pieces(t))
                    if len(seen) > 2 * COUNTED:
                        seen = Counter(dict(seen.most_common(COUNTED)))
        yield _sketched(seen)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for sketch in batch.column(0).to_pylist():
                seen.update(dict(json.loads(sketch)))
                if len(seen) > 2 * COUNTED:
                    seen = Counter(dict(seen.most_common(COUNTED)))
        if seen:
            yield _sketched(seen)

    total: Counter[str] = Counter()
    for r in docs.mapInArrow(count, "sketch binary").repartition(MERGERS).mapInArrow(merge, "sketch binary").collect():  # MERGERS rows at most
        total.update(dict(json.loads(r.sketch)))
    return [p for p, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT]]


_workers: dict[int, Counts] = {}


def count_tokens(spark: SparkSession, docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row.

    A null text is empty (0 tokens). A null id stays null. Repeated rows stay; other columns are not read; an empty table gives no rows.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    by_piece, merges = path.endswith(".json") and splits_at_spaces(path), mergeable(path)
    pieces = frequent_pieces(docs.select("text")) if by_piece else []
    table = spark.sparkContext.broadcast(dict(zip(pieces, Counts(path, {}, merges).lengths(pieces), strict=True)) if pieces else {})
    # Filled above: a bounded table, not one that grows with the input.
    key = table._jbroadcast.id() if hasattr(table, "_jbroadcast") else id(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _workers:
            _workers.clear()
            _workers[key] = Counts(path, table.value, merges)
        counts = _workers[key]
        for batch in batches:
            for part in slices(batch):
                ts = texts(part, "text")
                n = counts(ts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in ts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
