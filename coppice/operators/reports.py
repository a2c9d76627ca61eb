"""Reports on generations of idioms, model metrics, few-shot prompts and Python snippets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sast
from ..sources.tables import FOREST, forest, table
from .programs import outlines
from .trees import _DEG, _HOP, NEAREST, RADIUS, TOP

#: Snippets that show the rules of simplified trees.
SNIPPETS = ["np.mean", "os.path.join", "train_test_split", "def f(x):\n    return np.dot(x, x) + 1", "x = '#'  # note\ny = f'{x}a'", "def g(:", "# only a comment", "é = np.max(à)\nnp.min(é)"]

#: What ends the words of an entry point; numbers are those of Python's float().
STOP_WORDS = ["in", "of", "a", "to", "and", "for", "with", "that"]
NUMBER = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)$"
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: The same in a pattern of another dialect.
SPACE_SQL = r"[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def idioms(spark, sf_dir) -> DataFrame:
    """A generation table from the forest's neighbourhoods: size, hash of the shape, score, holes."""
    return outlines(forest(spark, sf_dir)[1], TOP, RADIUS, NEAREST)


def clusters(i: DataFrame) -> DataFrame:
    """Shapes of a size, numbered by how many idioms have them; ties by hash."""
    kinds = i.groupBy("size", "hash").agg(F.count("*").alias("members"), F.sum("score").alias("score"))
    return kinds.withColumn("cluster", F.row_number().over(Window.partitionBy("size").orderBy(F.desc("members"), "hash")))


def cluster_idioms(spark, sf_dir):
    i = idioms(spark, sf_dir)
    w = Window.partitionBy("size", "hash").orderBy(F.desc("score"), "prog", "anchor")
    best = i.withColumn("rank", F.row_number().over(w))
    return best.join(clusters(i).select("size", "hash", "cluster"), ["size", "hash"]).select("size", "cluster", "rank", "prog", "anchor", "score")


def reusability_diversity(spark, sf_dir):
    c = clusters(idioms(spark, sf_dir)).groupBy("size").agg(F.count("*").alias("diversity"), (F.sum("score") / F.sum("members")).alias("reuse"))
    log = lambda x: F.ln(F.when(F.col(x) <= 0, F.col(x) + 1).otherwise(F.col(x)))
    return c.select("size", "diversity", F.round("reuse", 6).alias("reusability"), F.round(log("diversity"), 6).alias("log_diversity"), F.round(log("reuse"), 6).alias("log_reusability"), (log("diversity") >= log("reuse")).alias("stop"))


def idiom_report_sort(spark, sf_dir):
    return clusters(idioms(spark, sf_dir)).select("size", "cluster", "members", "score").orderBy("size", "cluster")


def api_index(spark, sf_dir):
    i = idioms(spark, sf_dir).where("holes = 0 and score > 0")
    n = forest(spark, sf_dir)[0].select("prog", F.col("node").alias("anchor"), "span")
    return n.join(i, ["prog", "anchor"], "left").groupBy(F.col("span").alias("api")).agg(F.count("size").alias("idioms"), F.coalesce(F.sum("score"), F.lit(0)).alias("uses"))


def _counts(spark, sf_dir):
    is_ = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    return table(spark, sf_dir, "labels").agg(is_(1, 1).alias("tp"), is_(0, 1).alias("fp"), is_(1, 0).alias("fn"), is_(0, 0).alias("tn"))


def classification_metrics(spark, sf_dir):
    """toxic as the prediction of quality."""
    part = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    c = F.col
    return _counts(spark, sf_dir).select("tp", "fp", "fn", "tn", part(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")).alias("accuracy"), part(c("tp"), c("tp") + c("fp")).alias("precision"), part(c("tp"), c("tp") + c("fn")).alias("recall"))


def auroc_ap_hard(spark, sf_dir):
    """Both from hard predictions: one threshold, ties counted half."""
    p, n = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    tpr, fpr = F.col("tp") / p, F.col("fp") / n
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return _counts(spark, sf_dir).select(F.round((1 + tpr - fpr) / 2, 6).alias("auroc"), F.round(tpr * precision + (1 - tpr) * p / (p + n), 6).alias("ap"))


def pass_at_k(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    n = d.groupBy("source").agg(F.count("*").cast("int").alias("n"), F.count_if(F.col("quality") == 1).cast("int").alias("c"))
    k = n.select("source", "n", "c", F.explode(F.array(F.lit(1), F.lit(2), F.lit(5))).alias("k")).where("n >= k")
    miss = F.aggregate(F.sequence(F.lit(0), F.col("k") - 1), F.lit(1.0), lambda a, i: a * F.greatest(F.lit(0), F.col("n") - F.col("c") - i) / (F.col("n") - i))
    return k.select("source", "k", F.round(1 - miss, 6).alias("pass_at_k"))


def fewshot_leave_one_out(spark, sf_dir):
    """For each item the first other one in a fixed order by digest: only the first two can be anyone's."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.md5(F.col("item_id").cast("string")).alias("h"))
    two = b.orderBy("h").limit(2).agg(F.array_sort(F.collect_list(F.struct("h", "item_id"))).alias("two"))
    first = F.filter("two", lambda x: x["item_id"] != F.col("item_id"))[0]["item_id"]
    return b.join(F.broadcast(two), F.lit(True)).select("item_id", first.alias("shot"))


def entry_point(text: Column) -> Column:
    """A function name: the first four words, up to a number, a stop-word after the second or a delimiter, without punctuation."""
    first = F.slice(F.filter(F.split(text, SPACE), lambda x: x != ""), 1, 4)
    words = F.transform(first, F.lower)
    number = F.transform(words, lambda x: F.regexp_replace(x, r"(?<=[0-9])_(?=[0-9])", "").rlike(NUMBER))
    stop = F.transform(words, lambda x, k: x.isin(STOP_WORDS) & (k > 1))
    quoted = F.transform(words, lambda x: x.startswith("`") | x.startswith("'"))
    ends = F.zip_with(F.zip_with(number, stop, lambda a, b: a | b), quoted, lambda a, b: a | b)
    end = F.array_position(ends, True).cast("int")
    kept = F.slice(words, F.lit(1), F.when(end > 0, end - 1).otherwise(F.size(words)))
    plain = F.filter(F.transform(kept, lambda x: F.regexp_replace(x, r"[!-/:-@\[-`{-~]", "")), lambda x: x != "")
    named = F.when(F.size(plain) < 2, F.concat(F.array(F.lit("f")), plain)).otherwise(plain)
    return F.regexp_replace(F.array_join(named, "_"), "^¿", "")


def prompt_render(spark, sf_dir):
    """An entry point from an item's first words, and the prompt with the whole text."""
    name = entry_point(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "benchmark").select("item_id", name.alias("entry"), F.concat(F.lit("def "), name, F.lit("():\n    \"\"\""), F.coalesce("text", F.lit("")), F.lit("\"\"\"\n")).alias("prompt"))


def programs(spark, sf_dir) -> DataFrame:
    """Each line of a document as a program; most of prose doesn't parse, and has no tree."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "code"))
    return lines.select((F.col("doc_id") * (1 << 24) + F.col("k")).alias("prog"), "code")


def sast_table(programs: DataFrame) -> DataFrame:
    """prog, node, parent, type, span, relpos of every program that parses."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *r) for p, code in zip(b["prog"], b["code"], strict=True) for r in sast.rows_of(code or "")], columns=["prog", "node", "parent", "type", "span", "relpos"])

    return programs.select("prog", "code").mapInPandas(run, "prog long, node int, parent int, type string, span string, relpos int")


def sast_nodes(spark, sf_dir):
    return sast_table(programs(spark, sf_dir)).withColumn("span", F.translate("span", sast.HOLE, "#"))


def round_trips(programs: DataFrame) -> DataFrame:
    """prog, code put together from the rows of each program's tree, in the task that made them: a program's rows are never dealt out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            trees = ((p, sast.rows_of(code or "")) for p, code in zip(b["prog"], b["code"], strict=True))
            yield pd.DataFrame([(p, sast.code_of(rows)) for p, rows in trees if rows], columns=["prog", "code"])

    return programs.select("prog", "code").mapInPandas(run, "prog long, code string")


def sast_roundtrip(spark, sf_dir):
    return round_trips(programs(spark, sf_dir))


_I = f"WITH {FOREST}, {_DEG}, {_HOP}, i AS (SELECT prog, anchor, count(*) AS size, md5(string_agg(hop, ',' ORDER BY hop)) AS hash, count(*) FILTER (hop = 1) AS score, count(*) FILTER (hop = 2) AS holes FROM hood GROUP BY ALL), c AS (SELECT *, CAST(row_number() OVER (PARTITION BY size ORDER BY members DESC, hash) AS INTEGER) AS cluster FROM (SELECT size, hash, count(*) AS members, CAST(sum(score) AS BIGINT) AS score FROM i GROUP BY ALL))"
_LAB = "WITH n AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn FROM labels)"
_PROMPT = f"""WITH b AS (SELECT item_id, coalesce(text, '') AS text FROM benchmark),
w AS (SELECT item_id, text, list_transform(list_filter(regexp_split_to_array(text, '{SPACE_SQL}'), lambda x: x <> '')[1:4], lambda x: lower(x)) AS w FROM b),
c AS (SELECT *, list_filter(list_transform(w, lambda x, i: CASE WHEN regexp_matches(regexp_replace(x, '([0-9])_([0-9])', '\\1\\2', 'g'), '{NUMBER}') OR i > 2 AND list_contains({STOP_WORDS}, x) OR starts_with(x, '`') OR starts_with(x, chr(39)) THEN i END), lambda y: y IS NOT NULL) AS ends FROM w),
p AS (SELECT *, list_filter(list_transform(w[1:coalesce(ends[1] - 1, len(w))], lambda x: regexp_replace(x, '[!-/:-@\\[-`{{-~]', '', 'g')), lambda x: x <> '') AS p FROM c),
n AS (SELECT item_id, text, array_to_string(CASE WHEN len(p) < 2 THEN list_concat(['f'], p) ELSE p END, '_') AS entry FROM p)
SELECT item_id, entry, 'def ' || entry || '():' || chr(10) || '    ' || repeat(chr(34), 3) || text || repeat(chr(34), 3) || chr(10) AS prompt FROM n"""
SQL = {
    "cluster_idioms": f"{_I} SELECT i.size, cluster, rank, prog, anchor, i.score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY size, hash ORDER BY score DESC, prog, anchor) AS INTEGER) AS rank FROM i) AS i JOIN c USING (size, hash)",
    "reusability_diversity": f"{_I}, r AS (SELECT size, count(*) AS diversity, sum(score) / sum(members)::DOUBLE AS reuse FROM c GROUP BY 1), l AS (SELECT *, ln(CASE WHEN diversity <= 0 THEN diversity + 1 ELSE diversity END) AS ld, ln(CASE WHEN reuse <= 0 THEN reuse + 1 ELSE reuse END) AS lr FROM r) SELECT size, diversity, round(reuse, 6) AS reusability, round(ld, 6) AS log_diversity, round(lr, 6) AS log_reusability, ld >= lr AS stop FROM l",
    "idiom_report_sort": f"{_I} SELECT size, cluster, members, score FROM c",
    "api_index": f"{_I} SELECT span AS api, count(size) AS idioms, CAST(coalesce(sum(score), 0) AS BIGINT) AS uses FROM nodes LEFT JOIN (SELECT * FROM i WHERE holes = 0 AND score > 0) AS i ON i.prog = nodes.prog AND i.anchor = nodes.node GROUP BY 1",
    "classification_metrics": f"{_LAB} SELECT *, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall FROM n",
    "auroc_ap_hard": f"{_LAB}, r AS (SELECT tp / (tp + fn)::DOUBLE AS tpr, fp / (fp + tn)::DOUBLE AS fpr, tp / (tp + fp)::DOUBLE AS pr, (tp + fn) / (tp + fn + fp + tn)::DOUBLE AS base FROM n) SELECT round((1 + tpr - fpr) / 2, 6) AS auroc, round(tpr * pr + (1 - tpr) * base, 6) AS ap FROM r",
    "pass_at_k": "WITH n AS (SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS c FROM documents JOIN labels USING (doc_id) GROUP BY 1), k AS (SELECT *, unnest([1, 2, 5]) AS k FROM n) SELECT source, k, round(1 - list_product(list_transform(range(k), lambda i: greatest(0, n - c - i) / (n - i)::DOUBLE)), 6) AS pass_at_k FROM k WHERE n >= k",
    "fewshot_leave_one_out": "SELECT a.item_id, (SELECT b.item_id FROM benchmark AS b WHERE b.item_id <> a.item_id ORDER BY md5(CAST(b.item_id AS VARCHAR)) LIMIT 1) AS shot FROM benchmark AS a",
    "prompt_render": _PROMPT,
}
QUERIES = {f.__name__: f for f in (cluster_idioms, reusability_diversity, idiom_report_sort, api_index, classification_metrics, auroc_ap_hard, pass_at_k, fewshot_leave_one_out, prompt_render, sast_nodes, sast_roundtrip)}
