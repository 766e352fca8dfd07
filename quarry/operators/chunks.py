"""Chunking and parsing of files into chunks, symbols, references and imports."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Bytes of a chunk, and of one that takes the next one in; depth to which statements are
#: cut; characters of a signature and of a docstring.
LIMIT, SMALL, DEPTH = 1500, 300, 6
SIGNATURE_CHARS, DOC_CHARS = 240, 300


def chunk_lines(text: str | None, limit: int = LIMIT, first_line: int = 1) -> list[tuple[int, int, str]]:
    """(first line, last line, text): a new chunk at a blank or # line once the limit is passed, or
    anywhere beyond 1.3 times the limit; lines are clipped at the limit. Chunks of white space go."""
    out: list[tuple[int, int, str]] = []
    held: list[str] = []
    size, begin = 0, first_line

    def settle() -> None:
        if any(x.strip() for x in held):
            out.append((begin, begin + len(held) - 1, "\n".join(held)))

    for number, line in enumerate((text or "").split("\n"), first_line):
        line = line[:limit]
        soft = not line.strip() or line.startswith("#")
        if held and (size + len(line) > limit and soft or size > 1.3 * limit):
            settle()
            held, size, begin = [], 0, number
        held.append(line)
        size += len(line) + 1
    settle()
    return out


def line_chunks(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, chunk, first_line, last_line, text of (doc_id, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, k, a, b, t) for i, text in zip(frame["doc_id"], frame["text"], strict=True) for k, (a, b, t) in enumerate(chunk_lines(text, limit))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "first_line", "last_line", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk int, first_line int, last_line int, text string")


_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.ListComp, ast.Assert, ast.With, ast.match_case)


class _Walk(ast.NodeVisitor):
    """Symbols, references and imports of a module, in document order."""

    def __init__(self, lines: list[str]) -> None:
        self.lines = lines
        self.symbols: list[dict] = []
        self.refs: list[dict] = []
        self.imports: list[dict] = []
        self.scope: list[int] = []
        self.complexity = 0

    def _define(self, node: ast.AST, kind: str) -> None:
        outer = self.symbols[self.scope[-1]] if self.scope else None
        if kind == "function" and outer and outer["kind"] == "class":
            kind = "method"
        qual = f"{outer['qualname']}.{node.name}" if outer else node.name
        for d in node.decorator_list:
            self.visit(d)
        self.symbols.append({
            "name": node.name, "qualname": qual, "kind": kind, "first": node.lineno, "last": node.end_lineno, "parent": self.scope[-1] if self.scope else -1,
            "signature": self._signature(node), "doc": (ast.get_docstring(node, clean=False) or "").strip("\"' \n")[:DOC_CHARS],
        })
        self.complexity += kind != "class"
        self.scope.append(len(self.symbols) - 1)
        for base in getattr(node, "bases", []):
            if name := _last_name(base):
                self.refs.append({"name": name, "qualifier": "", "kind": "inherits", "line": base.lineno, "scope": self.scope[-1]})
        for child in node.body:
            self.visit(child)
        self.scope.pop()

    def _signature(self, node: ast.AST) -> str:
        """What precedes the body, on one line."""
        inner = node.body[0]
        start, end = (node.lineno, node.col_offset), (_first_line(inner), inner.col_offset)
        parts = [line.encode()[start[1] if n == start[0] else 0 : end[1] if n == end[0] else None] for n, line in enumerate(self.lines[start[0] - 1 : end[0]], start[0])]
        return " ".join(b" ".join(parts).decode("utf-8", "replace").split()).rstrip(" :@")[:SIGNATURE_CHARS]

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self._define(node, "function")

    def visit_AsyncFunctionDef(self, node: ast.AsyncFunctionDef) -> None:
        self._define(node, "function")

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._define(node, "class")

    def visit_Call(self, node: ast.Call) -> None:
        if name := _last_name(node.func):
            qualifier = ast.unparse(node.func.value)[:80] if isinstance(node.func, ast.Attribute) else ""
            self.refs.append({"name": name, "qualifier": qualifier, "kind": "call", "line": node.lineno, "scope": self.scope[-1] if self.scope else -1})
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.imports.append({"module": a.name, "name": "", "alias": a.asname or a.name.split(".")[0], "line": node.lineno})

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.imports.append({"module": "." * node.level + (node.module or ""), "name": a.name, "alias": a.asname or a.name, "line": node.lineno})

    def generic_visit(self, node: ast.AST) -> None:
        self.complexity += isinstance(node, _BRANCHES)
        if isinstance(node, ast.BoolOp):
            self.complexity += len(node.values) - 1
        super().generic_visit(node)


def _first_line(node: ast.AST) -> int:
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])


def _last_name(node: ast.AST) -> str:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else ""


def parse_python(text: str) -> dict | None:
    """Symbols, references, imports, complexity and the tree; None where the text is no valid module."""
    text = _unix(text)
    walk = _Walk(text.split("\n"))
    try:
        tree = ast.parse(text)
        walk.visit(tree)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    return {"symbols": walk.symbols, "refs": walk.refs, "imports": walk.imports, "complexity": walk.complexity, "tree": tree}


def _unix(text: str) -> str:
    """Lines end with a line feed alone, as the parser counts them."""
    return text.replace("\r\n", "\n").replace("\r", "\n")


def _inner(node: ast.AST) -> list[ast.stmt]:
    """The statements of all blocks of a statement, in order."""
    out = []
    for field in ("body", "handlers", "orelse", "finalbody", "cases"):
        for child in getattr(node, field, None) or []:
            out += child.body if field in ("handlers", "cases") else [child] if isinstance(child, ast.stmt) else []
    return out


def _spans(statements: list[ast.stmt], begin: int, end: int, size, limit: int, depth: int = 0) -> list[tuple[int, int]]:
    """Lines begin to end in spans of whole statements, each with the lines before it, of at most
    ``limit`` bytes; a longer statement gives its head and the spans of its blocks."""
    units, at = [], begin
    for node in statements:
        if node.end_lineno >= at:  # or else it is on the last line of the one before
            units.append((at, node.end_lineno, node))
            at = node.end_lineno + 1
    if not units:
        return [(begin, end)]
    units[-1] = (units[-1][0], end, units[-1][2])
    out: list[tuple[int, int]] = []
    held: tuple[int, int] | None = None
    for a, b, node in units:
        if held and (size(a, b) > limit or size(held[0], b) > limit):
            out.append(held)
            held = None
        if size(a, b) <= limit:
            held = (held[0] if held else a, b)
            continue
        inner = _inner(node)
        first = _first_line(inner[0]) if inner else 0
        if depth < DEPTH and first > _first_line(node):
            out += [(a, first - 1), *_spans(inner, first, b, size, limit, depth + 1)]
        else:
            out.append((a, b))
    return out + ([held] if held else [])


def syntax_chunks(text: str, tree: ast.Module, limit: int = LIMIT) -> list[tuple[int, int, str]]:
    """(first line, last line, text) along a Python module's statements. Each line that is not blank is
    in one chunk. Sizes are UTF-8 bytes; a chunk of less than SMALL takes the next one in if both fit, and
    one beyond twice the limit (a single literal, say) is cut by lines."""
    lines = _unix(text).split("\n")
    total = [0]
    for line in lines:
        total.append(total[-1] + len(line.encode("utf-8", "replace")) + 1)
    size = lambda a, b: total[b] - total[a - 1]
    merged: list[tuple[int, int]] = []
    for a, b in _spans(tree.body, 1, len(lines), size, limit):
        if merged and size(*merged[-1]) < SMALL and size(merged[-1][0], b) <= limit:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    out = []
    for a, b in merged:
        while a <= b and not lines[a - 1].strip():
            a += 1
        while b >= a and not lines[b - 1].strip():
            b -= 1
        if a <= b:
            body = "\n".join(lines[a - 1 : b])
            out += chunk_lines(body, limit, a) if size(a, b) > 2 * limit else [(a, b, body)]
    return out


def chunk_header(path: str, symbols: list[dict], first: int, last: int) -> tuple[int, str]:
    """The symbol that lines are about (-1: none), and their header: the path, the symbols around the
    lines, the first five that they define, and the signature."""
    around = min((s["last"] - s["first"], i) for i, s in enumerate([*symbols, {"first": first, "last": 1 << 40}]) if s["first"] <= first <= s["last"])[1]
    around = -1 if around == len(symbols) else around
    while around >= 0 and symbols[around]["first"] >= first:
        around = symbols[around]["parent"]
    starts_before = lambda s: s["parent"] in (-1, around) or symbols[s["parent"]]["first"] < first
    defined = [i for i, s in enumerate(symbols) if first <= s["first"] <= last and starts_before(s)]
    chain, i = [], around
    while i >= 0:
        chain.insert(0, f"{symbols[i]['kind']} {symbols[i]['name']}")
        i = symbols[i]["parent"]
    about = defined[0] if defined else around
    header = path + (f" :: in {' > '.join(chain)}" if chain else "")
    if defined:
        header += " :: defines " + ", ".join(f"{symbols[i]['kind']} {symbols[i]['name']}" for i in defined[:5])
    return about, header + (f"\n{symbols[about]['signature']}" if about >= 0 and symbols[about]["signature"] else "")


PARSED_SCHEMA = (
    "path string, complexity int, symbols array<struct<name:string,qualname:string,kind:string,first:int,last:int,parent:int,signature:string,doc:string>>, "
    "refs array<struct<name:string,qualifier:string,kind:string,line:int,scope:int>>, imports array<struct<module:string,name:string,alias:string,line:int>>"
)


def parse_files(files: DataFrame) -> DataFrame:
    """One row per Python file (path, content) with what ``parse_python`` finds; empty lists where it
    can't be parsed, so that the file still gets line chunks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = {"symbols": [], "refs": [], "imports": [], "complexity": 0}
        for frame in frames:
            rows = [{"path": p, **(parse_python(c or "") or empty)} for p, c in zip(frame["path"], frame["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "complexity", "symbols", "refs", "imports"])

    return files.select("path", "content").mapInPandas(run, PARSED_SCHEMA)


def file_chunks(files: DataFrame, limit: int = LIMIT) -> DataFrame:
    """path, chunk, first_line, last_line, symbol, header, text of files (path, content).

    Python files are cut along their syntax; other files, and Python that can't be parsed, by lines with the
    path as header. symbol is the place in ``parse_files``'s list, -1 for none. No rows for null or blank
    contents."""

    def cut(path: str, content: str) -> list[tuple]:
        parsed = parse_python(content) if path.endswith(".py") else None
        found = syntax_chunks(content, parsed["tree"], limit) if parsed else chunk_lines(content, limit)
        return [(path, k, a, b, *chunk_header(path, parsed["symbols"] if parsed else [], a, b), t) for k, (a, b, t) in enumerate(found)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [row for p, c in zip(frame["path"], frame["content"], strict=True) if p is not None for row in cut(p, c or "")]
            yield pd.DataFrame(rows, columns=["path", "chunk", "first_line", "last_line", "symbol", "header", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, chunk int, first_line int, last_line int, symbol int, header string, text string")
