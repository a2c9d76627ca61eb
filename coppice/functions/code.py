"""Scalars over code, predictions and prompts, as expressions where they can be; those that parse Python are plain functions for Arrow batches."""

from __future__ import annotations

import ast
import html
import io
import textwrap
import tokenize

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sast import hopeless

#: A completion ends before the first of these.
STOPS = ["\nclass", "\ndef", "\n#", "\nif", "\nprint"]
#: Fixed value: library names of import lines.
IMPORT = r"\s*(?:from|import)\s+(\w+(?:\s*,\s*\w+)*)"


def stripped(text: Column) -> Column:
    """Without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(text, r"\s+", " ")


def hole_count(span: Column) -> Column:
    return (F.length(span) - F.length(F.replace(span, F.lit("#"), F.lit("")))).cast("int")


def seeds(seed: Column) -> Column:
    """The APIs of a seed, which are joined by semicolons."""
    return F.split(seed, ";")


def marked(span: Column) -> Column:
    """The parts between a span's holes in <mark>, but for blank ones."""
    parts = F.transform(F.split(span, "#"), lambda p: F.when(F.trim(p) != "", F.concat(F.lit("<mark>"), p, F.lit("</mark>"))).otherwise(p))
    return F.array_join(parts, "#")


def libraries(source: Column) -> Column:
    """Names of import lines, one an entry; of a list, what white space separates (with its commas), as found by the pattern."""
    found = F.regexp_extract_all(source, F.lit(IMPORT), F.lit(1))
    return F.flatten(F.transform(found, lambda m: F.when(m.contains(","), F.filter(F.split(m, r"\s+"), lambda x: x != "")).otherwise(F.array(m))))


def is_library_call(call: Column, library: str, aliases: str) -> Column:
    """By prefix, or if the first name is within the alias text (as a substring, like the rule that it follows)."""
    return call.startswith(library + ".") | F.lit(aliases).contains(F.split_part(call, F.lit("."), F.lit(1)))


def clean_prediction(text: Column) -> Column:
    """The first section: lines without leading marks and outer white space, up to an empty one."""
    lines = F.transform(F.split(text, "\n"), lambda x: stripped(F.regexp_replace(x, "^#+", "")))
    end = F.array_position(lines, F.lit("")).cast("int")
    return F.array_join(F.slice(lines, F.lit(1), F.when(end > 0, end - 1).otherwise(F.size(lines))), "\n")


def truncated(text: Column) -> Column:
    """What stands before the first stop of each kind, one kind after another."""
    for stop in STOPS:
        text = F.substring_index(text, stop, 1)
    return text


def without_comments(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.ltrim(x).startswith("# ")), "\n")


def unique_assertions(text: Column) -> Column:
    """Lines trimmed, blank ones dropped, and assert lines only where none before is equal to them; other repeated lines stay."""
    lines = F.filter(F.split(text, "\n"), lambda x: stripped(x) != "")

    def step(kept: Column, line: Column) -> Column:
        own = stripped(line)
        return F.when(line.startswith("assert ") & F.array_contains(kept, own), kept).otherwise(F.concat(kept, F.array(own)))

    return F.array_join(F.aggregate(lines, F.array().cast("array<string>"), step), "\n")


def indented(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("    "), x)), "\n")


def dedented(text: Column) -> Column:
    """Each line without its first four characters, whatever they are."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.substring(x, 5, 1 << 30)), "\n")


def default_entry_point(task: Column) -> Column:
    return F.concat(F.lit("f_"), task.cast("string"))


def replaced_entry_point(head: Column, name: Column) -> Column:
    """The name between def and the parameters."""
    return F.concat(F.regexp_extract(head, r"^(.*?def\s+)", 1), name, F.regexp_extract(head, r"^.*?def\s+[^(]*(.*)$", 1))


def replaced_in_test(test: Column, name: Column) -> Column:
    return F.replace(test, F.lit("candidate"), name)


def hash_order(items: Column, seed: Column | int) -> Column:
    """The entries of an array in an order drawn by their digest: a repeatable shuffle."""
    drawn = F.transform(items, lambda x, k: F.struct(F.md5(F.concat_ws("|", F.lit(seed).cast("string") if isinstance(seed, int) else seed.cast("string"), k.cast("string"), x)).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(drawn), lambda s: s["x"])


def test_body(tests: Column, n: int, seed: int, padding: bool = False) -> Column:
    """n tests in a drawn order, dedented; with padding, tests are drawn again until there are n."""
    if n == 0:
        return F.lit("")
    order = hash_order(tests, seed)
    if padding:
        order = F.when(F.size(order) > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.get(order, k % F.size(order)))).otherwise(order)
    return F.array_join(F.transform(F.slice(order, 1, n), dedented), "")


def approximate_tokens(text: Column) -> Column:
    """Tokens of words of at most four letters, digits and marks: an estimate without a vocabulary."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[A-Za-z]{1,4}|[0-9]{1,3}|[^A-Za-z0-9\s]"), F.lit(0)))


def encoded(value: Column, kinds: list[str]) -> Column:
    """The place of a value in a fixed list; the last place, for others, where it isn't there."""
    at = F.array_position(F.array(*map(F.lit, kinds)), value)
    return F.when(at > 0, at - 1).otherwise(len(kinds)).cast("int")


# Parsing.


def parsed(code: str | None) -> ast.Module | None:
    if hopeless(code or ""):
        return None
    try:
        return ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def normalised(code: str | None) -> str | None:
    """Code parsed and written again; None if it doesn't parse."""
    tree = parsed(code)
    return ast.unparse(tree) if tree is not None else None


def dummy_function(code: str | None) -> str | None:
    """The statements as the body of main()."""
    tree = parsed(code)
    return None if tree is None or not tree.body else ast.unparse(ast.parse("def main():\n" + textwrap.indent(ast.unparse(tree), "    ")))


def dropped(code: str | None) -> str | None:
    """A module without its imports, classes and functions."""
    tree = parsed(code)
    if tree is None:
        return None
    tree.body = [n for n in tree.body if not isinstance(n, ast.Import | ast.ImportFrom | ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef)]
    return ast.unparse(tree)


def aliases(code: str | None) -> dict[str, str]:
    """What a module's own imports bind: full name to the name in use."""
    tree, out = parsed(code), {}
    for node in tree.body if tree else ():
        if isinstance(node, ast.Import):
            out |= {a.name: a.asname or a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module is not None:
            out |= {f"{node.module}.{a.name}": a.asname or a.name for a in node.names if a.name != "*"}
    return out


def valid_case(text: str | None, asserting: bool = False) -> bool:
    """Whether a test case compiles within a try block; asserting: and holds an assertion."""
    if not (text or "").strip() or asserting and "assert " not in text or hopeless(text):
        return False
    try:
        compile("try:\n" + textwrap.indent(text, "    ", lambda line: True) + "\nexcept:\n    pass", "case", "exec")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def masked(code: str | None) -> str | None:
    """Names that aren't called and no part of an attribute's head as VAR."""
    tree = parsed(code)
    if tree is None:
        return None
    keep = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)} | {id(n.value) for n in ast.walk(tree) if isinstance(n, ast.Attribute)}
    for n in ast.walk(tree):
        if isinstance(n, ast.Name) and id(n) not in keep:
            n.id = "VAR"
    return ast.unparse(tree)


def computed_from(code: str | None) -> list[tuple[int, str, str]]:
    """(line, target, source) for each name on the right of an assignment and each name on its left."""
    tree, out = parsed(code), []
    for n in ast.walk(tree) if tree else ():
        if isinstance(n, ast.Assign | ast.AugAssign | ast.AnnAssign) and n.value is not None:
            targets = n.targets if isinstance(n, ast.Assign) else [n.target]
            left = [x.id for t in targets for x in ast.walk(t) if isinstance(x, ast.Name)]
            out += [(n.lineno, a, x.id) for a in left for x in ast.walk(n.value) if isinstance(x, ast.Name)]
    return sorted(set(out))


def data_flow(code: str | None) -> list[tuple[str, str, int, int]]:
    """(kind, name, from line, to line): for each read or write of a name, its LAST_WRITE and LAST_READ before it, in the order of the text."""
    tree, out = parsed(code), []
    names = sorted(((n.lineno, n.col_offset, isinstance(n.ctx, ast.Load), n.id) for n in ast.walk(tree) if isinstance(n, ast.Name)), key=lambda x: x[:2]) if tree else []
    written: dict[str, int] = {}
    read: dict[str, int] = {}
    # A statement's right side is evaluated before its left side is bound.
    for line, _, load, name in sorted(names, key=lambda x: (x[0], not x[2], x[1])):
        if name in written:
            out.append(("LAST_WRITE", name, line, written[name]))
        if name in read:
            out.append(("LAST_READ", name, line, read[name]))
        (read if load else written)[name] = line
    return out


def control_flow(code: str | None) -> list[tuple[int, int]]:
    """(line, next line) between statements: in sequence, into branches and bodies, around loops, and past what returns or raises."""
    tree, out = parsed(code), set()

    def flow(body: list[ast.stmt], then: list[int]) -> None:
        for k, s in enumerate(body):
            after = [body[k + 1].lineno] if k + 1 < len(body) else then
            if isinstance(s, ast.If):
                for part in (s.body, s.orelse):
                    out.update((s.lineno, x) for x in ([part[0].lineno] if part else after))
                    flow(part, after)
            elif isinstance(s, ast.For | ast.While | ast.AsyncFor):
                out.add((s.lineno, s.body[0].lineno))
                flow(s.body, [s.lineno])
                out.update((s.lineno, x) for x in ([s.orelse[0].lineno] if s.orelse else after))
                flow(s.orelse, after)
            elif isinstance(s, ast.With | ast.AsyncWith | ast.Try):
                out.add((s.lineno, s.body[0].lineno))
                flow(s.body, after)
                for h in getattr(s, "handlers", ()):
                    out.add((s.lineno, h.body[0].lineno))
                    flow(h.body, after)
            else:
                if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                    flow(s.body, [])
                if not isinstance(s, ast.Return | ast.Raise):
                    out.update((s.lineno, x) for x in after)

    flow(tree.body if tree else [], [])
    return sorted(out)


def dot(rows: list[tuple]) -> str:
    """A simplified tree's rows (node, parent, type, span, ...) as a DOT graph."""
    quote = lambda x: '"' + str(x).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    lines = [f"  {r[0]} [label={quote(f'{r[2]}: {r[3]}')}];" for r in rows] + [f"  {r[1]} -> {r[0]};" for r in rows if r[1] is not None]
    return "\n".join(["digraph {", *lines, "}"])


def highlighted(code: str | None) -> str:
    """Code as HTML; words in <mark> stay marked."""
    return "<pre>" + html.escape(code or "", quote=False).replace("&lt;mark&gt;", "<mark>").replace("&lt;/mark&gt;", "</mark>") + "</pre>"


_NO_CODE = frozenset((tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER, tokenize.COMMENT))


def code_tokens(code: str | None) -> int | None:
    """Tokens of Python's own tokenizer; None where it fails."""
    try:
        return sum([t[0] not in _NO_CODE for t in tokenize.generate_tokens(io.StringIO(code or "").readline)])
    except (tokenize.TokenError, SyntaxError, IndentationError):
        return None
