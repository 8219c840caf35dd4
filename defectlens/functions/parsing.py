"""Program text -> array of the syntax nodes that features read.

The only step that leaves the JVM. It works row by row inside an Arrow batch, needs
no shuffle, and hands back what stands where; marks, decisions, libraries and every
feature are then native array expressions over that.
"""

from __future__ import annotations

import ast
import contextlib
import io
import re
import textwrap
import tokenize
import warnings

import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

from .shipping import ship_by_value

ship_by_value(__name__)

#: What is told of a node; nothing is counted or judged here.
_NODE_TYPE = pa.struct([
    ("kind", pa.string()),  # class of the syntax node
    ("parent", pa.int32()),  # place of the told node around it, -1 for the module
    ("role", pa.string()),  # the field of its own parent that holds it
    ("scope", pa.int32()),  # place of the definition whose body holds it, -1 module, -2 neither
    ("depth", pa.int32()),  # compound statements around it, itself included
    ("sizes", pa.list_(pa.int32())),  # lengths of its list fields, in the grammar's order
    ("head", pa.string()),  # class of the expression or pattern it is about
    ("name", pa.string()),  # name called by that expression, or type of that constant
    ("modules", pa.list_(pa.string())),  # dotted names that it imports from
])
_PARSE_TYPE = pa.struct([
    ("nodes", pa.list_(_NODE_TYPE)),
    ("source_lines", pa.int32()),
    ("raw_ok", pa.bool_()),
])

_COMMENT_OR_STRING = re.compile(r"#|[bru]{0,2}['\"]", re.IGNORECASE)
_LAYOUT = {tokenize.NL, tokenize.NEWLINE, tokenize.ENDMARKER, tokenize.INDENT, tokenize.DEDENT}
_UNPARSABLE = (SyntaxError, ValueError, RecursionError, MemoryError)

_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_NESTING = (ast.If, ast.For, ast.While, ast.With, ast.Try, ast.ExceptHandler)
_TOLD = (ast.stmt, ast.ExceptHandler, ast.match_case, ast.IfExp, ast.BoolOp, ast.comprehension)
#: The field that a node is about.
_SUBJECT = {"Expr": "value", "Return": "value", "Raise": "exc", "match_case": "pattern"}
# Nodes that hold nothing to tell.
_LEAVES = (ast.Name, ast.Constant, ast.expr_context, ast.alias, ast.arg)


def _parse(code):
    try:
        return ast.parse(code)
    except _UNPARSABLE:
        return None


@contextlib.contextmanager
def _silent():
    """No warnings of programs that are parsed inside; entered once per batch, as it costs half a parse."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        yield


def _subject(node):
    """Class and name of the expression or pattern that a node is about."""
    subject = getattr(node, _SUBJECT.get(type(node).__name__, ""), None)
    if subject is None:
        return None, None
    if isinstance(subject, ast.Constant):
        name = type(subject.value).__name__
    elif isinstance(subject, ast.Call):
        name = getattr(subject.func, "id", None)
    else:  # a pattern: the name it binds, if it tests nothing more
        name = None if getattr(subject, "pattern", subject) else "any"
    return type(subject).__name__, name


def _modules(node):
    if isinstance(node, ast.Import):
        return [part.name for part in node.names]
    return [node.module] if isinstance(node, ast.ImportFrom) and node.module else None


_TRAITS: dict[type, tuple] = {}  # a plain table, as it is shipped by value


def _traits(kind):
    """What the walk asks of a class of nodes."""
    found = _TRAITS.get(kind)
    if found is None:
        found = _TRAITS[kind] = (
            issubclass(kind, _NESTING), issubclass(kind, _TOLD), issubclass(kind, _DEFINITIONS), issubclass(kind, ast.Assert),
            issubclass(kind, ast.AST) and not issubclass(kind, _LEAVES))
    return found


def _nodes(tree):
    """Walk with an explicit stack, so deep programs cannot exhaust Python's own."""
    told = []
    stack = [(tree, -1, None, -1, 0)]
    while stack:
        node, parent, role, scope, depth = stack.pop()
        kind = type(node)
        nests, is_told, defines, asserts, _ = _traits(kind)
        depth += nests
        fields = [(field, getattr(node, field, None)) for field in kind._fields]
        if is_told:
            head, name = _subject(node)
            told.append({
                "kind": kind.__name__, "parent": parent, "role": role, "scope": scope, "depth": depth,
                "sizes": [len(value) for _, value in fields if type(value) is list],
                "head": head, "name": name, "modules": _modules(node),
            })
            parent = len(told) - 1
        for field, value in fields:
            inside = scope
            if defines:  # decorators, defaults and bases are in neither scope
                inside = parent if field == "body" else -2
            elif asserts:
                inside = -2
            for child in value if type(value) is list else (value,):
                if _traits(type(child))[-1]:
                    stack.append((child, parent, field, inside, depth))
    return told


def _source_lines(code, tree):
    """Lines that are neither blank, nor only a comment, nor part of a bare string.

    None when the text cannot be cut into tokens.
    """
    lines = [line.strip() for line in code.splitlines()]
    if tree is not None and '"""' not in code and "'''" not in code:
        plain = not any(map(_COMMENT_OR_STRING.match, lines))
        if plain:
            return sum(map(bool, lines))
    count, depth, first, kinds = 0, 0, 0, []
    try:
        for token in tokenize.generate_tokens(io.StringIO("\n".join(lines)).readline):
            if token.type in (tokenize.NEWLINE, tokenize.NL) and depth == 0:
                if kinds and kinds not in ([tokenize.COMMENT], [tokenize.STRING]):
                    count += sum(map(bool, lines[first:token.start[0]]))
                first, kinds = token.start[0], []
            elif token.type not in _LAYOUT:
                kinds.append(token.type)
                if token.type == tokenize.OP:
                    depth += (token.string in "([{") - (token.string in ")]}")
    except (tokenize.TokenError, *_UNPARSABLE):
        return None
    return count


def describe(code):
    """Node structs and line count of one program; nodes are None if it does not parse."""
    with _silent():
        return _described(code)


def _described(code):
    if code is None:
        return None
    flush_left = textwrap.dedent(code)
    tree = _parse(flush_left)
    raw_ok = tree is not None and (flush_left == code or _parse(code) is not None)
    return {
        "nodes": None if tree is None else _nodes(tree),
        "source_lines": _source_lines(code, tree),
        "raw_ok": raw_ok,
    }


@arrow_udf(from_arrow_type(_PARSE_TYPE))
def parse_code(codes: pa.Array) -> pa.Array:
    with _silent():
        return pa.array([_described(code) for code in codes.to_pylist()], type=_PARSE_TYPE)
