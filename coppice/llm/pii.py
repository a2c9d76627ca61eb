"""Personal data: patterns propose, checksums confirm, context scores (operator 10), in DataFrame functions only.

Positions come from the texts between matches: their lengths and those of the
matches, summed up. Patterns use possessive repetition, which finds the same
matches as plain repetition here but neither recurses nor tries a run again
from each of its characters, so long texts take linear time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 48
#: Words that speak against personal data.
AGAINST = r"(?i)\b(?:invoice|order|part|serial|sku|isbn|tracking|version|build|release|checksum|commit|sample|example|dummy)\b"
CHUNK = 256
#: Gaps within CONTEXT, of any characters or of none that make words.
NEARBY = r"(?s)^.{0,%d}$" % CONTEXT
APART = r"^[^A-Za-z0-9]{0,%d}$" % CONTEXT


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A cheap necessary condition on the text.
    near: str
    #: Score of a confirmed match, and what context words around it add; at 50 or more a span counts.
    score: int = 100
    context: str = ""
    bonus: int = 0
    #: Matches that count without context.
    sure: str = ""

    #: Gaps over which the context of one match holds for the next: lists and columns.
    link: str = ""
    #: What words that speak against personal data take away.
    malus: int = 0


#: The base kinds, in the order in which equal starts are listed, then the method's own.
KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 80, r"(?i)e-?mail|contact|write to|reach", 20, malus=30),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]", 60, r"(?i)\bip\b|address|host|server|client|login|ssh", 30, malus=40),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9](?:[\x20-]?+[0-9]){11}", 60, r"(?i)card|visa|master|amex|credit|debit|payment|cvv|expir", 40, malus=40),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 60, r"(?i)phone|\btel\b|mobile|call|fax|whatsapp|contact|reach", 30, malus=40),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", 60, r"(?i)iban|account|konto|bank", 40, link=NEARBY, malus=40),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-", 30, r"(?i)\bssn\b|social security|tax id", 40, link=NEARBY),
    Kind("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{40}|[0-9a-f]{64}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36})(?![A-Za-z0-9])", r"[0-9a-f]{40}|AKIA|ghp_", 20, r"(?i)(?:token|secret|password|passwd|api[_-]?key)[\"']?\s*[:=]", 60, r"^(?:AKIA|ghp_)", APART),
]
BASE = 4


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    d = F.reverse(F.split(number, "(?!^)(?=.)"))

    def worth(x: Column, k: Column) -> Column:
        v = x.cast("int") * F.when(k % 2 == 1, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.transform(d, worth), F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's check digits are right."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4)), "(?!^)(?=.)")
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(turned, F.lit(0), step) == 1


def confirmed(kind: str, x: Column) -> Column:
    d = digits_of(x)
    if kind == "ip":
        parts = F.transform(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | (F.length(p) == 3) & (p <= F.lit("255")))
    if kind == "card":
        return F.length(d).between(12, 19) & luhn(d)
    if kind == "phone":
        return F.length(d).between(9, 15)
    if kind == "iban":
        return mod97(x)
    return F.lit(True)


def _sums(lengths: Column, n: Column) -> Column:
    """Sums of the first 1, 2, ... n entries of a column, chunk by chunk, so that the work isn't quadratic in a text's matches."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)
    each = F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))
    chunks = F.transform(each, lambda c: F.slice(lengths, c * CHUNK + 1, CHUNK))

    def within(held: Column) -> Column:
        """All chunks and their sums are at hand once, and a chunk's own sums are of its entries alone."""
        before = lambda c: total(F.slice(held["sums"], F.lit(1), c))
        own = lambda x, b: F.transform(F.sequence(F.lit(1), F.size(x)), lambda k: b + total(F.slice(x, 1, k)))
        return F.flatten(F.transform(held["chunks"], lambda x, c: F.transform(F.array(before(c)), lambda b: own(x, b))[0]))

    bound = F.transform(F.array(chunks), lambda ch: F.struct(ch.alias("chunks"), F.transform(ch, total).alias("sums")))
    return F.transform(bound, within)[0]


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `spans`, array<struct<start int, kind int, end int, score int>> in order of start and kind; positions are code points, ends exclusive.

    kind is the index in KINDS; score is what its check and the words around it give, 0 to 100. Spans of the base kinds stay at any score, others from 50. A null text is empty: no spans. Matches of a kind are leftmost and don't overlap; those that fail their check are
    dropped without another try. Spans of different kinds may overlap.
    """
    df = docs.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    t = F.col("_t")
    some = []
    for k, kind in enumerate(KINDS):
        near = t.contains(kind.near) if kind.near == "@" else t.rlike(kind.near)
        pattern = F.lit(kind.pattern)
        df = df.withColumn(f"_m{k}", F.when(near, F.regexp_extract_all(t, pattern, F.lit(0))))
        df = df.withColumn(f"_g{k}", F.when(F.size(f"_m{k}") > 0, F.split(t, kind.pattern, -1)))
        m, g = F.col(f"_m{k}"), F.col(f"_g{k}")
        lengths = F.zip_with(F.slice(g, 1, F.size(m)), m, lambda a, b: F.length(a) + F.length(b))
        df = df.withColumn(f"_l{k}", F.when(g.isNotNull(), lengths))
        df = df.withColumn(f"_e{k}", F.when(g.isNotNull(), _sums(F.col(f"_l{k}"), F.size(m))))
        df = df.withColumn(f"_r{k}", F.when(g.isNotNull(), _near(kind, g, m) if k < BASE else _around(kind, g, m)))
        of = F.arrays_zip(m.alias("m"), F.col(f"_e{k}").alias("e"), F.when(g.isNotNull(), _judged(kind, F.col(f"_r{k}"), k < BASE)).alias("r"))
        made = F.transform(F.filter(of, _accepted(kind)), _placed(k))
        some.append(F.coalesce(F.when(g.isNotNull(), made), F.array().cast("array<struct<start:int,kind:int,end:int,score:int>>")))
    return df.withColumn("spans", F.sort_array(F.concat(*some))).drop("_t", *[f"_{c}{k}" for k in range(len(KINDS)) for c in "mgler"])


def _score(kind: Kind, before: Column, after: Column) -> Column:
    words = F.when(before.rlike(kind.context) | after.rlike(kind.context), kind.bonus).otherwise(0) if kind.context else F.lit(0)
    against = F.when(before.rlike(AGAINST) | after.rlike(AGAINST), kind.malus).otherwise(0) if kind.malus else F.lit(0)
    return F.least(F.greatest(F.lit(kind.score) + words - against, F.lit(0)), F.lit(100))


def _tail(x: Column) -> Column:
    return F.substring(x, -CONTEXT, CONTEXT)


def _head(x: Column) -> Column:
    return F.substring(x, 1, CONTEXT)


def _near(kind: Kind, g: Column, m: Column) -> Column:
    """For each match its score, by the words between it and its neighbours of the same kind."""
    n = F.size(m)
    return F.zip_with(F.slice(g, 1, n), F.slice(g, F.lit(2), n), lambda a, b: F.struct(_score(kind, _tail(a), _head(b)).alias("score"), F.lit(False).alias("sure"), F.lit(False).alias("link")))


def _around(kind: Kind, g: Column, m: Column) -> Column:
    """For each match its score by the words within CONTEXT characters on either side, whether it counts without, and whether it is linked to the one before.

    The texts around a match are put together from its neighbours' gaps and matches. Five on a side hold CONTEXT characters, for no such kind
    has matches of under eleven, with a character between. Shifted arrays keep this linear in a text's matches.
    """
    n = F.size(m)
    gaps = F.slice(g, 1, n)
    tails = F.zip_with(gaps, m, lambda a, b: F.concat(_tail(a), b))
    heads = F.concat(F.zip_with(gaps, m, lambda a, b: F.concat(_head(a), b)), F.transform(F.slice(g, -1, 1), _head))
    back = [F.slice(F.concat(F.array_repeat(F.lit(""), k), tails), F.lit(1), n).alias(f"b{k}") for k in range(5, 0, -1)]
    on = [F.slice(heads, F.lit(k + 1), n).alias(f"f{k}") for k in range(1, 6)]

    def one(x: Column) -> Column:
        before = _tail(F.concat_ws("", *[x[f"b{k}"] for k in range(5, 0, -1)], x["g"]))
        after = _head(F.concat_ws("", *[x[f"f{k}"] for k in range(1, 6)]))
        sure = x["m"].rlike(kind.sure) if kind.sure else F.lit(False)
        return F.struct(_score(kind, before, after).alias("score"), sure.alias("sure"), x["g"].rlike(kind.link).alias("link"))

    return F.transform(F.arrays_zip(gaps.alias("g"), m.alias("m"), *back, *on), one)


def _judged(kind: Kind, found: Column, base: bool) -> Column:
    """ok and score of each match: enough score, sure, or linked to such a match before it."""
    if base:
        return F.transform(found, lambda x: F.struct(F.lit(True).alias("ok"), x["score"].alias("score")))
    flags = F.transform(found, lambda x: F.when(x["sure"] | (x["score"] >= 50), "C").when(x["link"], "L").otherwise("."))
    held = F.split(F.regexp_replace(F.array_join(flags, ""), r"(?:(?<=C)|(?!^)\G)L", "C"), "(?!^)(?=.)")
    return F.zip_with(found, held, lambda x, c: F.struct((c == "C").alias("ok"), F.when(x["sure"], 100).otherwise(F.greatest(x["score"], F.lit(50))).alias("score")))


def _accepted(kind: Kind) -> Callable[[Column], Column]:
    return lambda x: confirmed(kind.name, x["m"]) & x["r"]["ok"]


def _placed(k: int) -> Callable[[Column], Column]:
    return lambda x: F.struct((x["e"] - F.length(x["m"])).alias("start"), F.lit(k).alias("kind"), x["e"].alias("end"), x["r"]["score"].alias("score"))


def listed(found: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: counts of the base kinds, a digest of the base spans, all spans as text, their number and their scores in the same order.

    A null or empty text has no spans. A null id stays null; repeated rows are each reported; other columns are not read, whatever their names; an empty
    table gives no rows.
    """
    df = spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")))
    base = F.filter("spans", lambda x: x["kind"] < BASE)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k].name}")
    scores = F.concat_ws(",", F.transform("spans", lambda x: x["score"].cast("string")))
    return df.select("doc_id", *[count(k) for k in range(BASE)], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), scores.alias("scores"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; where spans overlap the first one's mark stands for all.

    A null text stays null; repeated rows are each redacted; other columns stay, whatever their names; an empty table stays empty.
    """
    df = spans(docs.select(F.struct("*").alias("_row"), F.col(text).cast("string").alias("_text")), "_text")
    names = F.array(*[F.lit(f"[{k.name.upper()}]") for k in KINDS])
    t = F.col("_text")
    # CHUNK spans at a time, and within them only the stretch of text that they lie in: linear in the text, however many spans it has.
    n = F.size("spans")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda c: F.slice("spans", c * CHUNK + 1, CHUNK))

    def whole(a: Column, chunk: Column) -> Column:
        end = F.array_max(F.transform(chunk, lambda x: x["end"]))
        stretch = F.substring(t, a["at"] + 1, F.greatest(end - a["at"], F.lit(0)))

        def inside(s: Column) -> Column:
            def step(b: Column, x: Column) -> Column:
                new = F.array(F.substring(s, b["at"] - a["at"] + 1, x["start"] - b["at"]), F.get(names, x["kind"]))
                return F.struct(F.greatest(b["at"], x["end"]).alias("at"), F.when(x["start"] < b["at"], b["parts"]).otherwise(F.concat(b["parts"], new)).alias("parts"))

            return F.aggregate(chunk, F.struct(a["at"].alias("at"), F.array().cast("array<string>").alias("parts")), step, lambda b: F.struct(b["at"].alias("at"), F.concat(a["out"], F.array_join(b["parts"], "")).alias("out")))

        return F.transform(F.array(stretch), inside)[0]

    cleaned = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), whole, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    new = F.when(n > 0, cleaned).otherwise(t)
    return df.select(*[new.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])
