"""Code, prediction and prompt operators over whole tables: the scalars of functions.code as queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import code
from ..sources.tables import FOREST, forest, table

LIBRARY, ALIASES = "www", "mail,shop"


def _texts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _said(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def collapse_whitespace(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", code.collapsed(F.col("text")).alias("text"))


def library_imports(spark, sf_dir):
    """How often each library is imported, by the import pattern."""
    return _texts(spark, sf_dir).select(F.explode(code.libraries(F.col("text"))).alias("library")).groupBy("library").agg(F.count("*").alias("n"))


def library_calls(spark, sf_dir):
    """Dotted names of pages that belong to a library, by prefix or alias."""
    names = F.explode(F.regexp_extract_all("html", F.lit(r"[a-z]+(?:\.[a-z]+)+"), F.lit(0)))
    return table(spark, sf_dir, "pages").select(names.alias("call")).where(code.is_library_call(F.col("call"), LIBRARY, ALIASES)).groupBy("call").agg(F.count("*").alias("n"))


def hole_marks(spark, sf_dir):
    """Holes of each text, and its parts between them marked."""
    return _texts(spark, sf_dir).where(F.col("text").contains("#")).select("doc_id", code.hole_count(F.col("text")).alias("holes"), code.marked(F.col("text")).alias("marked"))


def idiom_file_names(spark, sf_dir):
    """File names packed from an idiom's numbers and parsed again; the seeds of its query."""
    packed = F.format_string("idiom_%d_%d_%d_%d.json", F.col("l_linenumber").cast("int"), (F.col("l_suppkey") % 7).cast("int"), F.col("l_quantity").cast("int"), (F.col("l_partkey") % 5).cast("int"))
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", packed.alias("file"), code.seeds(F.concat_ws(";", "l_returnflag", "l_linestatus")).alias("seeds"))
    part = F.split(F.split_part("file", F.lit("."), F.lit(1)), "_")
    return d.select("l_orderkey", "l_linenumber", "file", *[part[k + 1].cast("int").alias(n) for k, n in enumerate(("size", "cluster", "nhoods", "holes"))], F.size("seeds").alias("n_seeds"), F.col("seeds")[0].alias("first_seed"))


def clean_predictions(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", code.clean_prediction(F.col("text")).alias("text"))


def assertion_dedup(spark, sf_dir):
    """Lines as assertions: repeated ones go, repeated lines of another kind stay."""
    t = F.replace(F.col("text"), F.lit("\n"), F.lit("\nassert "))
    return _texts(spark, sf_dir).select("doc_id", code.unique_assertions(F.concat(t, F.lit("\n"), F.col("text"))).alias("text"))


def test_case_chunks(spark, sf_dir):
    """Cases between blank lines, with the entry point renamed, truncated, without comments and repeated assertions."""
    chunks = _texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("k", "chunk")).where(code.stripped(F.col("chunk")) != "")
    renamed = F.replace(F.col("chunk"), F.lit("the"), F.lit("candidate"))
    return chunks.select("doc_id", "k", code.unique_assertions(code.without_comments(code.stripped(code.truncated(renamed)))).alias("chunk"))


def indent_dedent(spark, sf_dir):
    return _said(spark, sf_dir).select("conv_id", "turn", code.indented(F.col("text")).alias("indented"), code.dedented(F.col("text")).alias("dedented"))


def entry_points(spark, sf_dir):
    """Default names, and names replaced in a head and in a test."""
    name = code.default_entry_point(F.col("item_id"))
    head = F.concat(F.lit("def old_"), F.col("item_id").cast("string"), F.lit("(x):"))
    test = F.concat(F.lit("assert candidate(1) == "), F.col("item_id").cast("string"), F.lit(" # candidate"))
    return table(spark, sf_dir, "benchmark").select("item_id", name.alias("entry"), code.replaced_entry_point(head, name).alias("head"), code.replaced_in_test(test, name).alias("test"))


def drawn_tests(spark, sf_dir):
    """Five of each conversation's texts in a drawn order, repeatable by seed."""
    d = _said(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("s")).select("conv_id", F.transform("s", lambda x: x["text"]).alias("tests"))
    return d.select("conv_id", F.slice(code.hash_order(F.col("tests"), 42), 1, 5).alias("t")).select("conv_id", F.array_join("t", "\n").alias("drawn"))


def approximate_tokens(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", code.approximate_tokens(F.col("text")).alias("n_tokens"))


def type_codes(spark, sf_dir):
    """Nodes by the codes of their types and labels; others have the last code."""
    n = forest(spark, sf_dir)[0]
    return n.select(code.encoded(F.col("type"), ["customer", "order"]).alias("type_code"), code.encoded(F.col("span"), ["BUILDING", "F", "NO"]).alias("span_code")).groupBy("type_code", "span_code").agg(F.count("*").alias("n"))


def adjacency_json(spark, sf_dir):
    """Each order's node and children to JSON and back."""
    edges = forest(spark, sf_dir)[1].where("src > 0").groupBy("prog", "src").agg(F.array_sort(F.collect_list("dst")).alias("children"))
    made = edges.select("prog", F.to_json(F.struct("src", "children")).alias("j"))
    back = made.select("prog", F.from_json("j", "src long, children array<long>").alias("x"))
    return back.select("prog", "x.src", F.size("x.children").alias("n"), F.array_join(F.transform("x.children", lambda c: c.cast("string")), ",").alias("children"))


def code_checks(spark, sf_dir):
    """Each line as code: does it parse, its normal form, as a function, without definitions, masked, as a case; tokens by Python's tokenizer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                for k, line in enumerate((text or "").split("\n")):
                    parses = code.parsed(line) is not None
                    forms = (code.normalised(line), code.dummy_function(line), code.dropped(line), code.masked(line)) if parses else (None,) * 4
                    rows.append((doc, k, parses, *forms, code.valid_case(line), code.code_tokens(line)))
            yield pd.DataFrame(rows, columns=["doc_id", "k", "parses", "normal", "dummy", "dropped", "masked", "valid", "n_tokens"])

    return _texts(spark, sf_dir).mapInPandas(run, "doc_id long, k int, parses boolean, normal string, dummy string, dropped string, masked string, valid boolean, n_tokens int")


_T = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"
_C = "(SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)"
_NL = "chr(10)"
_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_SPLIT = lambda x: f"string_split({x}, chr(10))"


def _unique(x: str) -> str:
    """SQL of unique_assertions: a line is kept unless it is an assertion whose trimmed text stands before."""
    full = f"list_filter({_SPLIT(x)}, lambda x: {_STRIP('x')} <> '')"
    trimmed = f"list_transform({full}, lambda x: {_STRIP('x')})"
    return f"array_to_string(list_filter(list_transform({full}, lambda x, i: CASE WHEN NOT starts_with(x, 'assert ') OR list_position({trimmed}, {_STRIP('x')}) = i THEN {_STRIP('x')} END), lambda y: y IS NOT NULL), chr(10))"


_TRUNC = lambda x: f"split_part(split_part(split_part(split_part(split_part({x}, chr(10) || 'class', 1), chr(10) || 'def', 1), chr(10) || '#', 1), chr(10) || 'if', 1), chr(10) || 'print', 1)"
_NOCOM = lambda x: f"array_to_string(list_filter({_SPLIT(x)}, lambda x: NOT starts_with(ltrim(x), '# ')), chr(10))"
SQL = {
    "collapse_whitespace": f"SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM {_T}",
    "library_imports": f"SELECT library, count(*) AS n FROM (SELECT unnest(flatten(list_transform(regexp_extract_all(text, '\\s*(?:from|import)\\s+(\\w+(?:\\s*,\\s*\\w+)*)', 1), lambda m: CASE WHEN contains(m, ',') THEN list_filter(regexp_split_to_array(m, '\\s+'), lambda x: x <> '') ELSE [m] END))) AS library FROM {_T}) GROUP BY 1",
    "library_calls": f"SELECT call, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '[a-z]+(?:\\.[a-z]+)+')) AS call FROM pages) WHERE starts_with(call, '{LIBRARY}.') OR contains('{ALIASES}', split_part(call, '.', 1)) GROUP BY 1",
    "hole_marks": f"SELECT doc_id, CAST(length(text) - length(replace(text, '#', '')) AS INTEGER) AS holes, array_to_string(list_transform(string_split(text, '#'), lambda p: CASE WHEN trim(p) <> '' THEN '<mark>' || p || '</mark>' ELSE p END), '#') AS marked FROM {_T} WHERE contains(text, '#')",
    "idiom_file_names": "SELECT l_orderkey, l_linenumber, 'idiom_' || l_linenumber || '_' || (l_suppkey % 7) || '_' || CAST(floor(l_quantity) AS INTEGER) || '_' || (l_partkey % 5) || '.json' AS file, CAST(l_linenumber AS INTEGER) AS size, CAST(l_suppkey % 7 AS INTEGER) AS cluster, CAST(floor(l_quantity) AS INTEGER) AS nhoods, CAST(l_partkey % 5 AS INTEGER) AS holes, 2 AS n_seeds, l_returnflag AS first_seed FROM lineitem",
    "clean_predictions": f"SELECT doc_id, array_to_string(CASE WHEN list_contains(l, '') THEN l[1:list_position(l, '') - 1] ELSE l END, chr(10)) AS text FROM (SELECT doc_id, list_transform({_SPLIT('text')}, lambda x: {_STRIP("regexp_replace(x, '^#+', '')")}) AS l FROM {_T})",
    "assertion_dedup": f"SELECT doc_id, {_unique('text')} AS text FROM (SELECT doc_id, replace(text, chr(10), chr(10) || 'assert ') || chr(10) || text AS text FROM {_T})",
    "test_case_chunks": f"SELECT doc_id, k, {_unique('c')} AS chunk FROM (SELECT doc_id, k, {_NOCOM('s')} AS c FROM (SELECT doc_id, k, {_STRIP(_TRUNC("replace(chunk, 'the', 'candidate')"))} AS s FROM (SELECT doc_id, CAST(unnest(range(len(c))) AS INTEGER) AS k, unnest(c) AS chunk FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS c FROM {_T})) WHERE {_STRIP('chunk')} <> ''))",
    "indent_dedent": f"SELECT conv_id, turn, array_to_string(list_transform({_SPLIT('text')}, lambda x: '    ' || x), chr(10)) AS indented, array_to_string(list_transform({_SPLIT('text')}, lambda x: substr(x, 5)), chr(10)) AS dedented FROM {_C}",
    "entry_points": "SELECT item_id, 'f_' || item_id AS entry, 'def f_' || item_id || '(x):' AS head, 'assert f_' || item_id || '(1) == ' || item_id || ' # f_' || item_id AS test FROM benchmark",
    "drawn_tests": f"SELECT conv_id, string_agg(text, chr(10) ORDER BY h, text) AS drawn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY h, text) AS r FROM (SELECT conv_id, text, md5('42|' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) || '|' || text) AS h FROM {_C})) WHERE r <= 5 GROUP BY 1",
    "approximate_tokens": f"SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z]{{1,4}}|[0-9]{{1,3}}|[^A-Za-z0-9\\s]')) AS INTEGER) AS n_tokens FROM {_T}",
    "type_codes": f"WITH {FOREST} SELECT CASE type WHEN 'customer' THEN 0 WHEN 'order' THEN 1 ELSE 2 END AS type_code, CASE span WHEN 'BUILDING' THEN 0 WHEN 'F' THEN 1 WHEN 'NO' THEN 2 ELSE 3 END AS span_code, count(*) AS n FROM nodes GROUP BY 1, 2",
    "adjacency_json": f"WITH {FOREST} SELECT prog, src, CAST(count(*) AS INTEGER) AS n, string_agg(dst, ',' ORDER BY dst) AS children FROM edges WHERE src > 0 GROUP BY 1, 2",
}
QUERIES = {f.__name__: f for f in (collapse_whitespace, library_imports, library_calls, hole_marks, idiom_file_names, clean_predictions, assertion_dedup, test_case_chunks, indent_dedent, entry_points, drawn_tests, approximate_tokens, type_codes, adjacency_json, code_checks)}
