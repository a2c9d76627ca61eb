"""Rule bitmask ledger for document quality (operator 1), in DataFrame functions only.

Every rule is evaluated once per document; the ledger keeps one bit per failed
rule beside the measurements. Versioned policies are masks over these bits, and
ablations are bitwise counts over the few distinct bit patterns, so neither
reads a text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Bit k of `failed` belongs to the k-th rule; a rule holds a document back where its condition is true.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "5 * n_symbols > n_words and n_words > 0",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines and n_dup_lines > 2",
    "long_words": "word_chars > 25 * n_words and n_words > 0",
    "short_words": "2 * word_chars < 3 * n_words and n_words > 0",
}
#: Policies by version: the rules each applies. The first two rules are the base that every policy contains.
POLICIES = {"v1": ["few_words", "repeated_words"], "v2": list(RULES)}
BASE = POLICIES["v1"]


def mask(rules: list[str]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (all long).

    A null text has no words; empty texts and texts of white space neither. Words are what stands between
    spaces, tabs, line feeds, vertical tabs, form feeds and carriage returns. Columns of the same names are replaced.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.array_remove(F.split(F.translate(t, SPACES, " " * len(SPACES)), " "), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn("_words", words).withColumn("_lines", lines)
    w = F.col("_words")
    m = F.size(w) - (WINDOW - 1)
    df = df.withColumn("_hashes", F.when(m > 1, F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))))
    # Only texts that hold a window twice (by hash) are looked at further: windows are equal if they agree in 128 bits, and no window's words are copied.
    again = F.size(F.array_distinct("_hashes")) < m
    other = lambda i: F.xxhash64(F.lit(1), *[F.get(w, i + k) for k in range(WINDOW)])
    df = df.withColumn("_sorted", F.when(again, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), other(i).alias("g"), i.alias("at"))))))
    s = F.col("_sorted")
    same = lambda a, b: F.when((a["h"] == b["h"]) & (a["g"] == b["g"]), F.array(a["at"], b["at"])).otherwise(F.array().cast("array<int>"))
    at = F.sort_array(F.array_distinct(F.flatten(F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), same))))
    df = df.withColumn("_at", F.when(s.isNotNull(), at))
    at = F.col("_at")
    gaps = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.least(F.lit(WINDOW), b - a))
    covered = F.when(F.size(at) > 0, F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda x, g: x + g)).otherwise(F.lit(0).cast("long"))
    chars = lambda dropped: F.length(F.translate(t, dropped, ""))
    return df.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": chars(SPACES).cast("long"),
            "n_symbols": (F.length(t) - chars(SYMBOLS)).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(at.isNotNull(), covered).otherwise(F.lit(0).cast("long")),
        }
    ).drop("_words", "_lines", "_hashes", "_sorted", "_at")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements and `failed`, the bits of the rules that hold each document back."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(RULES.values())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measure(docs, text).withColumn("failed", failed)


def passes(policy: str, bits: str = "failed") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail only it, and that the policy keeps without it."""
    whole = mask(POLICIES[policy])
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).alias("bit")) for r in POLICIES[policy]])).alias("r")
    of = F.col("bits").bitwiseAND(F.col("r.bit").cast("long"))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    return (
        patterns.select("bits", "n", rows)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(count(of != 0)("n_failed"), count(F.col("bits") == F.col("r.bit"))("n_only"), count((F.col("bits") - of) == 0)("n_kept_without"))
    )


def rules(docs: DataFrame, policy: str = "v2", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document with its measurements, base_failed, kept and the bits of its failed rules.

    A null or empty text has no words and fails few_words. A null id stays null; repeated rows are each judged; other columns are not read, whatever their
    names; an empty table gives no rows.
    """
    entries = ledger(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")))
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("failed").bitwiseAND(F.lit(mask(BASE))) != 0).alias("base_failed"), passes(policy).alias("kept"), "failed")


def keep(docs: DataFrame, policy: str = "v2", text: str = "text") -> DataFrame:
    """The rows of docs that a policy keeps, with their own columns, whatever their names.

    A null or empty text goes. Repeated rows are each judged; an empty table stays empty.
    """
    rows = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    # A filter would be moved below the measurements and hold a copy of each; an expanded list of one row or none isn't.
    return ledger(rows, "_text").select(F.explode(F.when(passes(policy), F.array("_row"))).alias("_row")).select("_row.*")
