"""Text operators: admission, keyword search, ranking, tf-idf, co-occurrence, windows and line rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import code
from ..sources.tables import table, written
from .code import _NOCOM, _TRUNC, _unique

KEYWORDS = ("the", "and")
K1, B = 1.2, 0.75
SPACES = r"[\x20\x09-\x0D]+"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def words(c: str = "text") -> Column:
    return F.array_remove(F.split(F.lower(c), SPACES), "")


def postings(d: DataFrame) -> DataFrame:
    """doc_id, term, tf: the inverted index as a table."""
    return d.select("doc_id", F.explode(words()).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def admit_documents(spark, sf_dir):
    """Whole texts of at most a mebibyte with 100 words or more."""
    d = docs(spark, sf_dir)
    return d.where((F.octet_length("text") <= 1 << 20) & (F.size(words()) >= 100)).select("doc_id", F.size(words()).cast("long").alias("n_tokens"))


def keyword_any_filter(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.where(F.col("text").contains("licensed") | F.col("text").contains("License")).select("doc_id")


def keyword_all_intersect(spark, sf_dir):
    p = postings(docs(spark, sf_dir)).where(F.col("term").isin(*KEYWORDS))
    return p.groupBy("doc_id").agg(F.countDistinct("term").alias("n")).where(F.col("n") == len(KEYWORDS)).select("doc_id")


def bm25(d: DataFrame, query: tuple[str, ...]) -> DataFrame:
    """doc_id, score of every document that holds a query word."""
    sized = d.select("doc_id", F.size(words()).alias("dl"), F.explode(F.array(*map(F.lit, query))).alias("term"), words().alias("w"))
    p = sized.select("doc_id", "dl", "term", F.size(F.filter("w", lambda x: x == F.col("term"))).alias("tf"))
    corpus = d.select(F.size(words()).alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("mean"))
    df = p.where("tf > 0").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    # Both broadcast sides are bounded: a row a query word, and one row.
    return p.where("tf > 0").join(F.broadcast(df), "term").join(F.broadcast(corpus), F.lit(True)).groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def bm25_topk(spark, sf_dir):
    return bm25(docs(spark, sf_dir), KEYWORDS).orderBy(F.desc("score"), "doc_id").limit(100)


def tfidf(tf: DataFrame, doc: str = "doc_id", term: str = "term") -> DataFrame:
    """Adds weight: tf * (ln((1 + N) / (1 + df)) + 1), each document's weights scaled to length 1."""
    df = tf.groupBy(term).agg(F.count("*").alias("df"))
    n = tf.select(doc).distinct().agg(F.count("*").alias("n_docs"))
    raw = tf.join(df, term).join(F.broadcast(n), F.lit(True)).withColumn("raw", F.col("tf") * (F.ln((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1))
    norm = raw.groupBy(doc).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, doc).withColumn("weight", F.col("raw") / F.col("norm"))


def term_weights(d: DataFrame) -> DataFrame:
    """term, weight: tfidf's weights summed by term. Texts are cut into words once, where their documents are; postings are dealt out twice, by term and by document."""
    p = written(d.sparkSession, postings(d.select("doc_id", "text").repartition("doc_id")))
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    n = p.agg(F.countDistinct("doc_id").alias("n_docs"))
    raw = p.join(df, "term").join(F.broadcast(n), F.lit(True)).select("doc_id", "term", (F.col("tf") * (F.ln((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id")))
    return raw.select("term", (F.col("raw") / norm).alias("weight")).groupBy("term").agg(F.round(F.sum("weight"), 6).alias("weight"))


def tfidf_term_rank(spark, sf_dir):
    """A report of the 100 terms of most weight."""
    return term_weights(docs(spark, sf_dir)).orderBy(F.desc("weight"), "term").limit(100)


def tfidf_doc_vectors_top100(spark, sf_dir):
    p = postings(docs(spark, sf_dir))
    vocabulary = p.groupBy("term").agg(F.sum("tf").alias("n")).orderBy(F.desc("n"), "term").limit(100).select("term")
    return tfidf(p.join(F.broadcast(vocabulary), "term", "left_semi")).select("doc_id", "term", F.round("weight", 6).alias("weight"))


def top_terms(spark, sf_dir):
    t = docs(spark, sf_dir).select(F.explode(words()).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return t.orderBy(F.desc("n"), "term").limit(100)


def _baskets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("part")).distinct()


def pairs_of(baskets: DataFrame) -> DataFrame:
    """Unordered pairs of each basket's distinct items; an order has at most a few lines."""
    b = baskets.select("doc_id", F.col("part").alias("b"))
    return baskets.select("doc_id", F.col("part").alias("a")).join(b, "doc_id").where("a < b")


def cooccurrence_pairs(spark, sf_dir):
    return pairs_of(_baskets(spark, sf_dir)).groupBy("a", "b").agg(F.count("*").alias("n"))


def pair_tfidf(spark, sf_dir):
    tf = pairs_of(_baskets(spark, sf_dir)).select("doc_id", F.concat_ws(";", "a", "b").alias("term"), F.lit(1).alias("tf"))
    return tfidf(tf).groupBy("term").agg(F.round(F.sum("weight"), 6).alias("weight"))


def regex_extract_calls(spark, sf_dir):
    calls = F.array_distinct(F.regexp_extract_all("html", F.lit(r"([a-z]+)\("), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(calls).alias("call")).groupBy("call").agg(F.count("*").alias("n"))


def file_to_repo_map(spark, sf_dir):
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return table(spark, sf_dir, "pages").select("page_id", host.alias("repo"), F.regexp_replace("url", "[/]", "__").alias("flat"))


def marker_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<li><a href=\"[^\"]*\">([^<]*)</a></li>"), F.lit(1))).alias("k", "item"))


def breakdown_units(spark, sf_dir):
    """A text's lines as units, numbered; blank ones and those that begin with `test` are skipped."""
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "unit"))
    return lines.where((F.trim("unit") != "") & ~F.lower("unit").startswith("test"))


def train_test_split_80_20(spark, sf_dir):
    """Splits by a digest of the id: no order over the corpus is needed, and a row's side never changes."""
    bucket = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 4), 16, 10).cast("int") % 10
    return docs(spark, sf_dir).select("doc_id", F.when(bucket < 8, "train").otherwise("test").alias("side"))


def _window(first: Column, last: Column) -> Column:
    start = F.greatest(F.lit(1), first - 2)
    return F.array_join(F.slice("lines", start, last + 2 - start + 1), "\n")


def _hits(keyword: str) -> Column:
    at = F.transform("lines", lambda x, i: F.when(x.contains(keyword), i + 1))
    return F.array_min(F.filter(at, lambda x: x.isNotNull()))


def context_window(spark, sf_dir):
    """Two lines about the first line with the keyword."""
    d = docs(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("lines")).withColumn("at", _hits("the"))
    return d.where("at is not null").select("doc_id", _window(F.col("at"), F.col("at")).alias("snippet"))


def context_window_multi(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("lines")).withColumn("a", _hits("the")).withColumn("b", _hits("and"))
    return d.where("a is not null and b is not null").select("doc_id", _window(F.least("a", "b"), F.greatest("a", "b")).alias("snippet"))


def stop_token_truncate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", code.truncated(F.coalesce("text", F.lit(""))).alias("head"))


def dedup_lines(spark, sf_dir):
    """Lines without comments, trimmed; blank ones go, and of the others only repeated assertions."""
    return docs(spark, sf_dir).select("doc_id", code.unique_assertions(code.without_comments(F.col("text"))).alias("text"))


def source_cube(spark, sf_dir):
    return docs(spark, sf_dir).cube("lang", "source").agg(F.count("*").alias("n"))


_D = "d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents), w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d)"
_P = _D + ", p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY ALL)"
_BASKETS = "k AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS part FROM lineitem), ab AS (SELECT x.doc_id, x.part AS a, y.part AS b FROM k AS x JOIN k AS y ON x.doc_id = y.doc_id AND x.part < y.part)"


def _tfidf_sql(tf: str) -> str:
    return f"""df AS (SELECT term, count(*) AS df FROM {tf} GROUP BY 1), r AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(DISTINCT doc_id) FROM {tf})) / (1 + df)::DOUBLE) + 1) AS raw FROM {tf} JOIN df USING (term)),
tw AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM r)"""


_LINES = "l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM d), h AS (SELECT doc_id, lines, list_position(list_transform(lines, lambda x: contains(x, 'the')), true) AS a, list_position(list_transform(lines, lambda x: contains(x, 'and')), true) AS b FROM l)"

SQL = {
    "admit_documents": f"WITH {_D} SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens FROM w WHERE len(w) >= 100 AND strlen(text) <= 1048576",
    "keyword_any_filter": f"WITH {_D} SELECT doc_id FROM d WHERE contains(text, 'licensed') OR contains(text, 'License')",
    "keyword_all_intersect": f"WITH {_D} SELECT doc_id FROM w WHERE list_contains(w, 'the') INTERSECT SELECT doc_id FROM w WHERE list_contains(w, 'and')",
    "bm25_topk": f"""WITH {_P}, n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w), t AS (SELECT p.doc_id, tf, len(w) AS dl, count(*) OVER (PARTITION BY term) AS df FROM p JOIN w USING (doc_id) WHERE term IN ('the', 'and'))
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM t, n GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""",
    "tfidf_term_rank": f"WITH {_P}, {_tfidf_sql('p')} SELECT term, round(sum(weight), 6) AS weight FROM tw GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
    "tfidf_doc_vectors_top100": f"WITH {_P}, vocab AS (SELECT term FROM p GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 100), pv AS (SELECT * FROM p WHERE term IN (SELECT term FROM vocab)), {_tfidf_sql('pv')} SELECT doc_id, term, round(weight, 6) AS weight FROM tw",
    "top_terms": f"WITH {_P} SELECT term, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
    "cooccurrence_pairs": f"WITH {_BASKETS} SELECT a, b, count(*) AS n FROM ab GROUP BY ALL",
    "pair_tfidf": f"WITH {_BASKETS}, p AS (SELECT doc_id, a || ';' || b AS term, 1 AS tf FROM ab), {_tfidf_sql('p')} SELECT term, round(sum(weight), 6) AS weight FROM tw GROUP BY 1",
    "regex_extract_calls": "SELECT call, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(html, '([a-z]+)\\(', 1))) AS call FROM pages) GROUP BY 1",
    "file_to_repo_map": "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS repo, replace(url, '/', '__') AS flat FROM pages",
    "marker_extract": "SELECT page_id, CAST(generate_subscripts(m, 1) - 1 AS INTEGER) AS k, unnest(m) AS item FROM (SELECT page_id, regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a></li>', 1) AS m FROM pages)",
    "breakdown_units": f"WITH {_D}, u AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS k, unnest(l) AS unit FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM d)) SELECT doc_id, CAST(k AS INTEGER) AS k, unit FROM u WHERE trim(unit) <> '' AND NOT starts_with(lower(unit), 'test')",
    "train_test_split_80_20": "SELECT doc_id, CASE WHEN CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4) AS INT) % 10 < 8 THEN 'train' ELSE 'test' END AS side FROM documents",
    "context_window": f"WITH {_D}, {_LINES} SELECT doc_id, array_to_string(lines[greatest(1, a - 2):a + 2], chr(10)) AS snippet FROM h WHERE a > 0",
    "context_window_multi": f"WITH {_D}, {_LINES} SELECT doc_id, array_to_string(lines[greatest(1, least(a, b) - 2):greatest(a, b) + 2], chr(10)) AS snippet FROM h WHERE a > 0 AND b > 0",
    "stop_token_truncate": f"SELECT conv_id, turn, {_TRUNC("coalesce(text, '')")} AS head FROM conversations",
    "dedup_lines": f"WITH {_D} SELECT doc_id, {_unique(_NOCOM('text'))} AS text FROM d",
    "source_cube": "SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)",
}
QUERIES = {f.__name__: f for f in (admit_documents, keyword_any_filter, keyword_all_intersect, bm25_topk, tfidf_term_rank, tfidf_doc_vectors_top100, top_terms, cooccurrence_pairs, pair_tfidf, regex_extract_calls, file_to_repo_map, marker_extract, breakdown_units, train_test_split_80_20, context_window, context_window_multi, stop_token_truncate, dedup_lines, source_cube)}
