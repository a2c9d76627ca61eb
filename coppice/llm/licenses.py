"""Licence scan: word bigrams of normalised text against templates by Dice coefficient (operator 9), in DataFrame functions only.

A text is normalised once; its units are cut from the normalised text: sentences, lines,
paragraphs, the whole, and windows. A window is as long as a template and stands where at
least a quarter of the template's seed bigrams have their places in it; so a notice is found
however its lines are wrapped, inside other lines, and behind comment marks, which
normalising drops.

Bounds prune before anything is compared:

* Size. A unit with n bigrams can reach the threshold t only with templates of t/(2-t)*n
  to (2-t)/t*n bigrams; templates are listed under each size that they admit.
* Prefix. With a template of n bigrams a unit must share at least t/(2-t)*n. Anchor words
  are chosen so that fewer bigrams than that are without any: a text that contains no
  anchor word matches nothing, and is never normalised. This loses no match.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import TEMPLATES

THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words too frequent in any text to prune by.
FREQUENT = frozenset("a all an and any are as at be by can do either for from have if in is it may more not of on or other out see should that the this to under use used version with without work you your".split())


def words(text: str) -> list[str]:
    return [w for w in re.sub(r"[^a-z0-9]+", " ", text.translate(str.maketrans(UPPER, LOWER))).split(" ") if w]


def bigrams(text: str) -> list[str]:
    w = words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def admitted(n: int, t: float) -> range:
    """Sizes of units that can reach the threshold with a template of n bigrams."""
    return range(math.ceil(t / (2 - t) * n - 1e-9), math.floor((2 - t) / t * n + 1e-9) + 1)


def least_shared(n: int, t: float) -> int:
    """Fewest bigrams that a matching unit shares with a template of n."""
    return math.ceil(t / (2 - t) * n - 1e-9)


@lru_cache(maxsize=8)
def anchors(listed: tuple[tuple[str, str], ...], t: float) -> tuple[str, ...]:
    """Words such that every matching unit of every template has one: of each template, fewer bigrams than must be shared are without any."""
    todo = [(set(b), least_shared(len(b), t)) for _, x in listed if (b := bigrams(x))]
    out: list[str] = []
    while todo := [({b for b in left if not out or out[-1] not in b.split(" ")}, k) for left, k in todo if len({b for b in left if not out or out[-1] not in b.split(" ")}) >= k]:
        gain: Counter[str] = Counter()
        for left, k in todo:
            for w, n in Counter(w for b in left for w in set(b.split(" "))).items():
                gain[w] += min(n, len(left) - k + 1) / (len(left) - k + 1) * (1e-6 if w in FREQUENT or len(w) < 3 else 1)
        out.append(max(gain, key=lambda w: (gain[w], len(w), w)))
    return tuple(out)


def seeds(listed: tuple[tuple[str, str], ...], t: float) -> dict[str, list[tuple[int, int]]]:
    """Bigrams with an anchor word that a template holds once, and their places (template, word offset)."""
    of, out = set(anchors(listed, t)), {}
    for k, (_, x) in enumerate(listed):
        w = words(x)
        pairs = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        often = Counter(pairs)
        for at, p in enumerate(pairs):
            if often[p] == 1 and of & set(p.split(" ")):
                out.setdefault(p, []).append((k, at))
    return out


def votes(listed: tuple[tuple[str, str], ...], places: dict[str, list[tuple[int, int]]]) -> list[int]:
    """How many seeds of each template must have their places in a window."""
    held = Counter(k for at in places.values() for k, _ in at)
    return [max(1, -(-held[k] // 4)) for k in range(len(listed))]


def scan(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text: str = "text", listed: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row a document: n_units (distinct matching units), license and score (thousandths of the best Dice coefficient, rounded down), licenses (all, sorted).

    Without a match, or with a null or empty text, n_units and score are 0, license is null and licenses is empty. Ties go to the first template.
    Repeated rows are each reported; a null id is an id like others; other columns are not read, whatever their names; an empty table gives no rows.
    """
    known = tuple(map(tuple, listed or TEMPLATES))
    grams = [bigrams(x) for _, x in known]
    by_size: dict[int, list[int]] = {}
    for k, b in enumerate(grams):
        for s in admitted(len(b), threshold) if b else ():
            by_size.setdefault(s, []).append(k)
    least, most = min(by_size), max(by_size)
    places = seeds(known, threshold)
    ints = lambda xs: F.split(F.lit(" ".join(map(str, xs))), " ").cast("array<int>")
    # Literals: one string each, taken apart once when the plan is made.
    of_size = F.create_map(*[x for s, ks in sorted(by_size.items()) for x in (F.lit(s), ints(ks))])
    held = F.array(*[F.split(F.lit(",".join(b)), ",") for b in grams])
    sizes, lengths, needed = ints(map(len, grams)), ints(len(words(x)) for _, x in known), ints(votes(known, places))
    listed_seeds = F.split(F.lit(",".join(places)), ",")
    seed_places = F.split(F.lit(",".join(" ".join(f"{k}:{at}" for k, at in at_all) for at_all in places.values())), ",")

    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), t.alias("_t"))
    low = F.lower("_t")
    hit = None
    for w in anchors(known, threshold):
        hit = low.contains(w) if hit is None else hit | low.contains(w)
    df = df.withColumn("_s", F.when(hit, _normal(F.col("_t")))).drop("_t")
    flat = F.trim(F.regexp_replace("_s", "[ \\n\\x01]+", " "))
    df = df.withColumn("_w", F.split(flat, " "))
    df = df.withColumn("_p", F.zip_with(F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0))), F.slice("_w", 2, F.size("_w")), lambda a, b: F.concat_ws(" ", a, b)))
    df = df.withColumn("_here", F.array_intersect("_p", listed_seeds))
    at = F.filter(F.transform("_p", lambda b, i: F.when(F.array_contains("_here", b), F.struct(b.alias("b"), i.alias("i")))), lambda x: x.isNotNull())
    df = df.withColumn("_at", F.when(F.size("_here") > 0, at))

    def windows(x: Column) -> Column:
        found = F.split(F.get(seed_places, F.array_position(listed_seeds, x["b"]).cast("int") - 1), " ")

        def window(p: Column) -> Column:
            k, off = F.split_part(p, F.lit(":"), F.lit(1)).cast("int"), F.split_part(p, F.lit(":"), F.lit(2)).cast("int")
            return F.struct(k.alias("k"), (x["i"] - off).alias("first"))

        return F.transform(found, window)

    df = df.withColumn("_at", F.sort_array(F.flatten(F.transform("_at", windows))))
    # In order, the n-th of equals stands n - 1 places behind the first.
    df = df.withColumn("_at", F.array_distinct(F.filter("_at", lambda x, i: x == F.get("_at", i + F.get(needed, x["k"]) - 1))))
    cut = F.transform("_at", lambda x: F.array_join(F.slice("_w", F.greatest(x["first"], F.lit(0)) + 1, F.get(lengths, x["k"]) + F.least(x["first"], F.lit(0))), " "))
    lines = F.regexp_replace("_s", "\\x01", " ")
    own = F.concat(F.split("_s", "[\\n\\x01]"), F.split(lines, "\\n"), F.split(lines, "\\n *\\n"), F.array(flat))
    tidy = lambda x: F.trim(F.regexp_replace(x, "[ \\n]+", " "))
    df = df.withColumn("_u", F.when(F.size("_here") > 0, F.array_distinct(F.concat(F.transform(F.filter(own, lambda x: F.length(x) > 2 * least), tidy), cut)))).drop("_s", "_w", "_p", "_here", "_at")

    def paired(unit: Column) -> Column:
        w = F.split(unit, " ")
        return F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))

    pairs = F.filter(F.transform(F.filter("_u", lambda u: F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit(""))) >= least), paired), lambda b: F.size(b).between(least, most))
    df = df.withColumn("_b", pairs).drop("_u")

    def best(b: Column) -> Column:
        score = lambda k: F.floor(F.lit(2000) * F.size(F.array_intersect(b, F.get(held, k))) / (F.size(b) + F.get(sizes, k))).cast("int")
        return F.array_max(F.transform(F.try_element_at(of_size, F.size(b)), lambda k: F.struct(score(k).alias("s"), (-k).alias("k"))))

    limit = round(threshold * 1000)
    df = df.withColumn("_m", F.coalesce(F.filter(F.transform("_b", best), lambda x: x["s"] >= limit), F.array().cast("array<struct<s:int,k:int>>"))).drop("_b")
    top = F.array_max("_m")
    names = F.split(F.lit(",".join(name for name, _ in known)), ",")
    return df.select(
        "doc_id",
        F.size("_m").cast("long").alias("n_units"),
        F.get(names, -top["k"]).alias("license"),
        F.coalesce(top["s"], F.lit(0)).cast("long").alias("score"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_m", lambda x: F.get(names, -x["k"])))), ",").alias("licenses"),
    )


def _normal(t: Column) -> Column:
    """Words of a-z and 0-9 between single marks: \\x01 for the end of a sentence within a line, line feeds, else spaces."""
    low = F.translate(F.regexp_replace(t, "\\x01", " "), UPPER, LOWER)
    return F.regexp_replace(F.regexp_replace(low, "(?<=[.!?:;])[\\x20\\t]+", "\x01"), "[^a-z0-9\\n\\x01]+", " ")
