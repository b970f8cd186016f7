"""Declarations and uses in Python sources, by the standard parser."""

from __future__ import annotations

import ast
from collections.abc import Iterator

#: Statements that make what they contain conditional.
CONTROL = {
    ast.If: "if", ast.For: "for", ast.AsyncFor: "async_for", ast.While: "while", ast.Try: "try",
    ast.TryStar: "try_star", ast.With: "with", ast.AsyncWith: "async_with", ast.Match: "match",
}
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def parsed(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _signature(node: ast.AST) -> str:
    if isinstance(node, FUNCTIONS):
        return f"({ast.unparse(node.args)})"
    words = [f"**{ast.unparse(k.value)}" if k.arg is None else f"{k.arg}={ast.unparse(k.value)}" for k in node.keywords]
    return f"({', '.join([*map(ast.unparse, node.bases), *words])})"


def _first_doc_line(node: ast.AST) -> str | None:
    lines = (ast.get_docstring(node, clean=False) or "").strip().splitlines()
    return lines[0].strip() or None if lines else None


def declarations(tree: ast.Module) -> Iterator[tuple]:
    """(kind, name, signature, start, end, doc, parent, scope_kind, is_conditional, context). A stack of nodes with their
    surroundings, so that deep nesting doesn't recurse."""
    todo = [(child, (), "module", ()) for child in reversed(list(ast.iter_child_nodes(tree)))]
    while todo:
        node, scope, scope_kind, control = todo.pop()
        inner, inner_kind, inner_control = scope, scope_kind, control
        if isinstance(node, (ast.ClassDef, *FUNCTIONS)):
            prefix = "async_" if isinstance(node, ast.AsyncFunctionDef) else ""
            kind = "class" if isinstance(node, ast.ClassDef) else f"{prefix}{'method' if scope_kind == 'class' else 'function'}"
            yield kind, ".".join((*scope, node.name)), _signature(node), node.lineno, node.end_lineno or node.lineno, _first_doc_line(node), ".".join(scope) or None, scope_kind, bool(control), ">".join(control) or None
            inner, inner_kind = (*scope, node.name), "class" if isinstance(node, ast.ClassDef) else "function"
        elif type(node) in CONTROL:
            inner_control = (*control, CONTROL[type(node)])
        todo += [(child, inner, inner_kind, inner_control) for child in reversed(list(ast.iter_child_nodes(node)))]


def dotted(node: ast.AST) -> str | None:
    names = []
    while True:
        if isinstance(node, ast.Call):
            node = node.func
        elif isinstance(node, ast.Attribute):
            names.append(node.attr)
            node = node.value
        else:
            return ".".join([node.id, *reversed(names)]) if isinstance(node, ast.Name) else None


def uses(tree: ast.Module) -> Iterator[tuple[int, str, str, str, str]]:
    """(line, name, kind, evidence, confidence). A name that is a base or is called is not a read as well."""
    told = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef):
            told |= {id(b) for b in node.bases if isinstance(b, ast.Name)}
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            told.add(id(node.func))
    for node in ast.walk(tree):
        match node:
            case ast.Import():
                yield from ((node.lineno, a.name, "import", f"import {a.name}", "high") for a in node.names)
            case ast.ImportFrom():
                for a in node.names:
                    if a.name != "*":
                        yield node.lineno, f"{node.module or ''}.{a.name}".strip("."), "import", f"from {node.module or '.'} import {a.name}", "high"
            case ast.ClassDef():
                for b in filter(None, map(dotted, node.bases)):
                    yield node.lineno, b, "inheritance", f"class {node.name}({b})", "high"
            case ast.Call() if name := dotted(node.func):
                kind = "instantiation" if name.rpartition(".")[2][:1].isupper() else "call"
                yield node.lineno, name, kind, f"{name}()", "high" if "." in name else "medium"
            case ast.Name() if id(node) not in told and isinstance(node.ctx, ast.Load):
                yield node.lineno, node.id, "read", node.id, "low"
            case ast.Name() if id(node) not in told and isinstance(node.ctx, ast.Store):
                yield node.lineno, node.id, "write", f"{node.id} = ...", "low"
