"""Python sources, by the interpreter's own parser."""

from __future__ import annotations

import ast
import warnings

from .common import Collector, Form, ParseError, kind_from_path, qualified
from .tree import Node, Placeholders, branch, leaf

#: Spelling of operators.
OPERATORS = {
    ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.FloorDiv: "//", ast.Mod: "%", ast.Pow: "**", ast.MatMult: "@", ast.LShift: "<<", ast.RShift: ">>", ast.BitOr: "|", ast.BitAnd: "&", ast.BitXor: "^",
    ast.And: "and", ast.Or: "or", ast.Not: "not", ast.Invert: "~", ast.UAdd: "+", ast.USub: "-",
    ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Is: "is", ast.IsNot: "is not", ast.In: "in", ast.NotIn: "not in",
}
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
SKIPPED = (ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop)


def _literal(value: object) -> str:
    if value is True:
        return "true"
    if value is False:
        return "false"
    if value is None:
        return "none"
    if isinstance(value, (str, bytes)):
        return "lit_str"
    if isinstance(value, int):
        return "lit_int"
    return "ellipsis" if value is Ellipsis else "lit_float"


class Emitter:
    """Trees of one form; nested functions are stubs, so that they don't count twice."""

    def __init__(self) -> None:
        self.names = Placeholders()

    def many(self, nodes: list[ast.AST]) -> list[Node]:
        return [self.emit(n) for n in nodes]

    def name(self, spelling: str) -> Node:
        return leaf(self.names(spelling))

    def emit(self, node: ast.AST) -> Node:
        if isinstance(node, FUNCTIONS):
            return leaf("function_definition")
        if isinstance(node, ast.Lambda):
            return leaf("lambda")
        if isinstance(node, ast.Name):
            return self.name(node.id)
        if isinstance(node, ast.Constant):
            return leaf(_literal(node.value))
        if isinstance(node, ast.JoinedStr):
            return leaf("lit_str")
        if isinstance(node, ast.BinOp):
            return branch(f"bin:{OPERATORS[type(node.op)]}", self.many([node.left, node.right]))
        if isinstance(node, ast.BoolOp):
            return branch(f"bin:{OPERATORS[type(node.op)]}", self.many(node.values))
        if isinstance(node, ast.Compare):
            return branch(f"bin:{OPERATORS[type(node.ops[0])]}", self.many([node.left, *node.comparators]))
        if isinstance(node, ast.UnaryOp):
            return branch(f"unary:{OPERATORS[type(node.op)]}", self.many([node.operand]))
        if isinstance(node, ast.AugAssign):
            return branch(f"assign:{OPERATORS[type(node.op)]}=", self.many([node.target, node.value]))
        return branch(type(node).__name__.lower(), self._fields(node))

    def _fields(self, node: ast.AST) -> list[Node]:
        """Children in the order of the fields; names that are plain strings are placeholders too."""
        out: list[Node] = []
        for field, value in ast.iter_fields(node):
            if field in ("type_comment", "kind", "ctx", "type_params", "conversion", "simple", "level", "is_async"):
                continue
            if isinstance(value, str):
                out += [self.name(p) for p in value.split(".")]
            elif isinstance(value, ast.AST):
                if not isinstance(value, SKIPPED):
                    out.append(self.emit(value))
            elif isinstance(value, list) and value:
                some = [self.name(v) if isinstance(v, str) else self.emit(v) for v in value if isinstance(v, (str, ast.AST)) and not isinstance(v, SKIPPED)]
                out.append(branch(field, some)) if field in ("body", "orelse", "finalbody", "handlers") else out.extend(some)
        return out


class Extractor:
    def __init__(self, out: Collector, kind: str):
        self.out, self.kind = out, kind

    def walk(self, node: ast.AST, owner: str | None, bound: str | None) -> None:
        """``owner``: the class around; ``bound``: the name that a lambda would get."""
        if isinstance(node, FUNCTIONS):
            self.form(qualified(owner, node.name), node.body)
            for d in (*node.decorator_list, *node.args.defaults, *(x for x in node.args.kw_defaults if x)):
                self.walk(d, owner, None)
            for s in node.body:
                self.walk(s, None, node.name)
        elif isinstance(node, ast.Lambda):
            self.form(bound or f"$lambda:L{node.lineno}", [node.body])
            self.walk(node.body, None, None)
        elif isinstance(node, ast.ClassDef):
            for c in ast.iter_child_nodes(node):
                self.walk(c, node.name, None)
        elif isinstance(node, (ast.Assign, ast.AnnAssign)) and node.value is not None:
            target = node.targets[0] if isinstance(node, ast.Assign) else node.target
            self.walk(node.value, owner, ast.unparse(target) if isinstance(target, (ast.Name, ast.Attribute)) else bound)
        elif isinstance(node, ast.Dict):
            for k, v in zip(node.keys, node.values, strict=True):
                self.walk(v, owner, ast.unparse(k) if k is not None else bound)
        else:
            for c in ast.iter_child_nodes(node):
                self.walk(c, owner, bound)

    def form(self, name: str, body: list[ast.AST]) -> None:
        start, end = min(x.lineno for x in (body[0], *getattr(body[0], "decorator_list", ()))), body[-1].end_lineno or body[-1].lineno
        if self.out.wants(start, end):
            e = Emitter()
            self.out.add(name, start, end, self.kind, branch("block", e.many(body)), e.names.trace)


def normalize(path: str, source: str, marker: str, min_nodes: int, min_lines: int) -> list[Form]:
    if path.endswith(".pyi"):
        return []
    out = Collector(source, marker, min_nodes, min_lines)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
        Extractor(out, kind_from_path(path, "py")).walk(tree, None, None)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise ParseError(f"parse error: {e}") from e
    return out.forms
