"""Simplified syntax trees of Python snippets, and snippets from trees.

A tree's nodes carry their own source with each child's place held open; the place is the control character HOLE
inside, shown as `#`, so a literal # in a string is never taken for one.
"""

from __future__ import annotations

import ast
import io
import keyword
import re
import tokenize
from collections import deque
from dataclasses import dataclass, field

HOLE = "\x01"


@dataclass
class Node:
    kind: str
    start: int
    end: int
    children: list[Node] = field(default_factory=list)
    span: str = ""


#: Two names side by side, in code before any text, comment or joined line.
_BESIDE = re.compile(r"(?<!\w)(?=([^\W\d]\w*)[ \t]+([^\W\d]\w*))")
_OTHER = re.compile(r"[\"'#\\\\]")
_KEYWORDS = frozenset([*keyword.kwlist, *keyword.softkwlist])


def hopeless(code: str) -> bool:
    """Whether code can't parse, seen without parsing: two names side by side, neither a keyword, are no Python, and prose has them at once."""
    m = _OTHER.search(code)
    return any(not _KEYWORDS & {*x.groups()} for x in _BESIDE.finditer(code, 0, m.start() if m else len(code)))


def parsed(code: str) -> ast.Module | None:
    """The module; None for what Python's parser refuses, also as nested too deep for it: it overflows over long lines of words, which aren't programs."""
    if hopeless(code):
        return None
    try:
        return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return None
    except MemoryError as e:
        if "overflow" not in str(e):  # memory itself ran out
            raise
        return None


def strip_comments(code: str) -> str:
    """Without comments, strings that stand as statements, and blank lines; what doesn't tokenize or parse stays as it is."""
    if hopeless(code):
        return code
    try:
        tokens = list(tokenize.generate_tokens(io.StringIO(code).readline))
    except (SyntaxError, tokenize.TokenError, ValueError):
        return code
    tree = parsed(code)
    if tree is None:
        return code
    lines = [list(x) for x in code.splitlines(keepends=True)]
    for t in tokens:
        if t.type == tokenize.COMMENT:
            lines[t.start[0] - 1][t.start[1] : t.end[1]] = " " * (t.end[1] - t.start[1])
    offset = _offsets(code)
    text = [c for line in lines for c in line]
    for n in ast.walk(tree):
        body = getattr(n, "body", None)
        if isinstance(body, list) and len(body) > 1:
            for s in body[:1]:
                if isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str):
                    a, b = offset(s.lineno, s.col_offset), offset(s.end_lineno, s.end_col_offset)
                    text[a:b] = [c if c == "\n" else " " for c in text[a:b]]
    return "\n".join(x.rstrip() for x in "".join(text).split("\n") if x.strip())


def _offsets(code: str):
    """Character positions of (line, byte column)."""
    lines = code.splitlines(keepends=True)
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x))
    return lambda line, column: starts[line - 1] + len(lines[line - 1].encode()[:column].decode("utf-8", "ignore"))


def tree_of(code: str) -> tuple[str, Node] | None:
    """The stripped code and its tree; None if it doesn't parse or holds nothing."""
    code = strip_comments(code)
    module = parsed(code)
    if module is None or not module.body:
        return None
    at = _offsets(code)

    def made(n: ast.AST, below: list[Node]) -> list[Node]:
        if not hasattr(n, "lineno"):  # operators and argument lists have no place of their own
            return below
        if isinstance(n, ast.FunctionDef) and n.decorator_list:
            marks = {(at(d.lineno, d.col_offset), at(d.end_lineno, d.end_col_offset)) for d in n.decorator_list}
            below = [b for b in below if not any(a <= b.start and b.end <= e for a, e in marks)]
        kind = "Name" if isinstance(n, ast.arg) else type(n).__name__
        start, end = at(n.lineno, n.col_offset), at(n.end_lineno, n.end_col_offset)
        if len(below) == 1 and (below[0].start, below[0].end) == (start, end):
            return below
        if isinstance(n, ast.JoinedStr):  # the pieces of a formatted string aren't code on their own
            below = []
        return [Node(kind, start, end, below)]

    # Children first, without recursion: chains of operators and attributes nest deeper than Python's calls may.
    top: list[Node] = []
    stack: list[tuple[ast.AST, list[Node], list[Node] | None]] = [(s, top, None) for s in reversed(module.body)]
    while stack:
        n, into, below = stack.pop()
        if below is not None:
            into += made(n, below)
            continue
        below = []
        stack.append((n, into, below))
        stack += [(c, below, None) for c in reversed(list(ast.iter_child_nodes(n))) if not isinstance(c, (ast.Load, ast.Store, ast.Del))]

    root = Node("Module", 0, len(code), top)
    todo = deque([root])
    while todo:
        n = todo.popleft()
        kept, end = [], n.start
        for c in sorted(n.children, key=lambda c: (c.start, c.end)):
            if c.start >= end:
                kept.append(c)
                end = c.end
        n.children, parts, x = kept, [], n.start
        for c in kept:
            parts += [code[x : c.start], HOLE]
            x = c.end
        n.span = "".join([*parts, code[x : n.end]])
        todo.extend(kept)
    return code, root


def rows_of(code: str) -> list[tuple[int, int, str, str, int]]:
    """node, parent (-1 for the root), type, span, relpos, numbered breadth first."""
    got = tree_of(code)
    if not got:
        return []
    out, todo, n = [], deque([(got[1], -1, 0)]), 0
    while todo:
        node, parent, k = todo.popleft()
        out.append((n, parent, node.kind, node.span, k))
        todo.extend((c, n, i) for i, c in enumerate(node.children))
        n += 1
    return out


def code_of(rows: list[tuple[int, int, str, str, int]]) -> str:
    """The snippet of a tree's rows; places that no child fills show as #."""
    kids: dict[int, dict[int, int]] = {}
    spans = {}
    for node, parent, _, span, k in rows:
        kids.setdefault(parent, {})[k] = node
        spans[node] = span

    out: list[str] = []
    todo: list[int | str] = list(reversed(kids.get(-1, {}).values()))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        parts, mine = spans[x].split(HOLE), kids.get(x, {})
        for k in reversed(range(len(parts))):
            todo += [mine[k] if k in mine else "#" if k < len(parts) - 1 else "", parts[k]]
    return "".join(out)


def units_of(code: str) -> list[tuple[str, str]]:
    """(name, source) of a file's snippets: methods of classes first, then functions; names that begin with test are left out."""
    module = parsed(code)
    if module is None:
        return []
    methods = [f for c in module.body if isinstance(c, ast.ClassDef) for f in c.body if isinstance(f, ast.FunctionDef)]
    functions = [f for f in module.body if isinstance(f, ast.FunctionDef)]
    return [(f.name, ast.unparse(f)) for f in [*methods, *functions] if not f.name.startswith("test")]


def calls_of(code: str) -> list[str]:
    """Dotted names that a snippet uses, with each of their beginnings, through import aliases."""
    module = parsed(code)
    if module is None:
        return []
    alias = {}
    for n in ast.walk(module):
        if isinstance(n, ast.Import):
            alias |= {a.asname or a.name.split(".")[0]: a.name if a.asname else a.name.split(".")[0] for a in n.names}
        elif isinstance(n, ast.ImportFrom):
            alias |= {a.asname or a.name: f"{n.module or ''}.{a.name}".lstrip(".") for a in n.names}
    found = set()
    for n in ast.walk(module):
        if isinstance(n, ast.Attribute):
            path, x = [n.attr], n.value
            while isinstance(x, ast.Attribute):
                path.append(x.attr)
                x = x.value
            if isinstance(x, ast.Name):
                found.add(".".join([alias.get(x.id, x.id), *reversed(path)]))
    return sorted(found)
