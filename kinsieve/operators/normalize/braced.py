"""Rust, Go and TypeScript sources, by their brackets.

No parser of these languages is at hand, so a file is split into tokens, tokens are nested by
their brackets, and functions are recognised by what stands before their body. A body
becomes a tree of blocks, statements, groups and tokens: names are placeholders, literals
keep their kind only, operators and keywords stay. Nested functions are stubs. This tells
the same functions equal, renamed or nearly equal as a grammar would; its digests are its own.
A file whose brackets or strings don't close is a parse error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ...schema import PRODUCTION, TEST
from .common import Collector, Form, ParseError, kind_from_path, qualified
from .tree import Node, Placeholders, branch, leaf

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")
GROUPS = {"(": "paren", "[": "bracket", "{": "block"}
KEYWORDS = {
    "rs": frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while yield".split()),
    "go": frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var true false nil iota".split()),
    "ts": frozenset("as async await break case catch class const continue debugger default delete do else enum export extends false finally for from function get if implements import in instanceof interface let new null of return set static super switch this throw true try type typeof undefined var void while with yield".split()),
}
OPERATORS = r"<<=|>>=|\.\.\.|\.\.=|===|!==|\*\*=|&&=|\|\|=|\?\?=|>>>|&\^=|=>|->|::|:=|<-|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|&\^|\?\?|\?\.|\.\.|\*\*"
NUMBER = r"(?P<num>0[xXbBoO][0-9a-fA-F_]+\w*|[0-9][0-9_]*(?:\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9_]+)?\w*)"
NAME = r"(?P<name>[^\W\d]\w*|\$\w*|#[^\W\d]\w*)"
SPACE = r"(?P<space>[^\S\n]+)|(?P<newline>\n)"
LEXERS = {
    "rs": re.compile(rf"{SPACE}|(?P<comment>//[^\n]*)|(?P<open_comment>/\*)|(?P<raw>b?r(?P<hash>#*)\")|(?P<str>b?c?\"(?:[^\"\\]|\\.)*\")|(?P<char>b?'(?:[^'\\\n]|\\(?:u\{{[^}}]*\}}|x..|.))')|(?P<life>'[^\W\d]\w*)|{NUMBER}|(?P<name>(?:r#)?[^\W\d]\w*)|(?P<op>{OPERATORS}|.)", re.S),
    "go": re.compile(rf"{SPACE}|(?P<comment>//[^\n]*)|(?P<open_comment>/\*)|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`)|(?P<char>'(?:[^'\\\n]|\\[^\n]+?)')|{NUMBER}|{NAME}|(?P<op>{OPERATORS}|.)", re.S),
    "ts": re.compile(rf"{SPACE}|(?P<comment>//[^\n]*)|(?P<open_comment>/\*)|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<tick>`)|{NUMBER}|{NAME}|(?P<op>{OPERATORS}|.)", re.S),
}
REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")


@dataclass
class Token:
    kind: str  # name, keyword, op, open, lit_...
    text: str
    line: int
    group: list | None = None  # what an opening bracket holds
    end: int = 0  # its closing line
    after_newline: bool = False


def _nested_comment(source: str, at: int, nests: bool) -> int:
    depth, i = 1, at
    while depth:
        m = re.compile(r"/\*|\*/" if nests else r"\*/").search(source, i)
        if not m:
            raise ParseError("parse error: comment without an end")
        depth += 1 if m.group() == "/*" else -1
        i = m.end()
    return i


def _template(source: str, at: int) -> tuple[int, bool]:
    """(end, whether it has substitutions) of a template string that starts at the tick."""
    i, depth, has = at + 1, 0, False
    while i < len(source):
        c = source[i]
        if c == "\\":
            i += 1
        elif depth == 0 and c == "`":
            return i + 1, has
        elif source.startswith("${", i) and depth == 0:
            depth, has, i = 1, True, i + 1
        elif depth and c == "{":
            depth += 1
        elif depth and c == "}":
            depth -= 1
        elif depth and c == "`":
            i = _template(source, i)[0] - 1
        i += 1
    raise ParseError("parse error: template without an end")


def tokens(source: str, lang: str) -> list[Token]:
    out: list[Token] = []
    lexer, keywords = LEXERS[lang], KEYWORDS[lang]
    pos, line, fresh = 0, 1, False
    while pos < len(source):
        start = line
        prev = out[-1] if out else None
        if lang == "ts" and source[pos] == "/" and (prev is None or prev.kind in ("op", "open") or prev.text in ("return", "typeof", "case", "in", "of")) and (m := REGEX.match(source, pos)):
            kind, text, end = "lit_regex", m.group(), m.end()
        else:
            m = lexer.match(source, pos)
            kind, text, end = m.lastgroup or "op", m.group(), m.end()
            if kind == "hash":
                kind = "raw"
        if kind == "open_comment":
            end = _nested_comment(source, end, lang == "rs")
        elif kind == "raw":
            close = source.find('"' + m.group("hash"), end)
            if close < 0:
                raise ParseError("parse error: string without an end")
            end = close + 1 + len(m.group("hash"))
            kind = "lit_bytestr" if text[0] == "b" else "lit_str"
        elif kind == "tick":
            end, has = _template(source, pos)
            kind = "template" if has else "lit_str"
        text = source[pos:end]
        line += text.count("\n")
        pos = end
        if kind in ("space", "comment", "open_comment", "newline"):
            fresh |= "\n" in text or kind == "newline"
            continue
        if kind == "str":
            kind = "lit_bytestr" if text[0] == "b" else "lit_str"
        elif kind == "char":
            kind = {"rs": "lit_byte" if text[0] == "b" else "lit_char", "go": "lit_rune"}[lang]
        elif kind == "life":
            kind = "op"
            text = "'_"
        elif kind == "num":
            hexed = text[:2].lower() in ("0x", "0b", "0o")
            kind = "lit_imag" if lang == "go" and text.endswith("i") else "lit_float" if not hexed and re.search(r"[.eE]|f32$|f64$", text) else "lit_int"
        elif kind == "name":
            kind = "keyword" if text in keywords else "name"
        elif kind == "op" and text in ('"', "'", "`"):
            raise ParseError(f"parse error: string without an end on line {start}")
        elif text in OPEN:
            kind = "open"
        out.append(Token(kind, text, start, end=line, after_newline=fresh))
        fresh = False
    return out


def nest(flat: list[Token]) -> list[Token]:
    """Tokens with what stands between brackets inside the opening one."""
    root: list[Token] = []
    stack: list[tuple[Token | None, list[Token]]] = [(None, root)]
    for t in flat:
        if t.kind == "open":
            t.group = []
            stack[-1][1].append(t)
            stack.append((t, t.group))
        elif t.kind == "op" and t.text in CLOSE:
            top = stack[-1][0]
            if top is None or OPEN[top.text] != t.text:
                raise ParseError(f"parse error: unexpected {t.text} on line {t.line}")
            top.end = t.line
            stack.pop()
        else:
            stack[-1][1].append(t)
    if len(stack) > 1:
        raise ParseError(f"parse error: {stack[-1][0].text} on line {stack[-1][0].line} is never closed")
    return root


@dataclass
class Function:
    name: str | None  # None: anonymous
    body: list[Token]
    start: int
    end: int
    first: int  # index of its first token
    last: int  # index behind its last one
    braced: bool = True


def _skip_angles(row: list[Token], i: int) -> int:
    """Behind type parameters in angle brackets, if some start at i."""
    if i < len(row) and row[i].text == "<":
        depth = 0
        while i < len(row):
            t = row[i].text
            depth += {"<": 1, ">": -1, "<<": 2, ">>": -2, ">>>": -3, ">=": -1}.get(t, 0) if row[i].kind == "op" else 0
            i += 1
            if depth <= 0:
                break
    return i


def _body_after(row: list[Token], i: int, stops: frozenset[str]) -> int | None:
    """The index of the block that a signature's rest leads to."""
    before_type = False
    while i < len(row):
        t = row[i]
        if t.kind == "open" and t.text == "{":
            if not before_type:
                return i
        elif t.kind == "op" and t.text in stops:
            return None
        before_type = t.text in ("interface", "struct", ":", "|", "&") and t.kind in ("op", "keyword")
        i += 1
    return None


EXPRESSION_END = frozenset([",", ";"])


def _expression_end(row: list[Token], i: int, lang: str) -> int:
    k = i
    while k < len(row):
        t = row[k]
        if t.kind == "op" and t.text in EXPRESSION_END:
            break
        if lang == "ts" and k > i and t.after_newline and t.kind in ("keyword", "name") and row[k - 1].kind != "op":
            break
        k += 1
    return k


def rust_function(row: list[Token], i: int) -> Function | None:
    t = row[i]
    if t.text == "fn" and t.kind == "keyword" and i + 1 < len(row) and row[i + 1].kind == "name":
        k = _skip_angles(row, i + 2)
        if k < len(row) and row[k].text == "(":
            b = _body_after(row, k + 1, frozenset([";"]))
            if b is not None:
                return Function(row[i + 1].text.removeprefix("r#"), row[b].group, t.line, row[b].end, i, b + 1)
        return None
    if t.kind == "op" and t.text in ("|", "||"):
        prev = row[i - 1] if i else None
        if prev is not None and not (prev.kind == "op" and prev.text not in (")", "]") or prev.text in ("move", "return", "async", "else", "in")):
            return None
        k = i + 1
        if t.text == "|":
            while k < len(row) and row[k].text != "|":
                k += 1
            k += 1
        first = i - 1 if prev is not None and prev.text == "move" else i
        typed = k < len(row) and row[k].text == "->"
        if typed:
            b = _body_after(row, k, EXPRESSION_END)
        else:
            b = k if k < len(row) and row[k].kind == "open" and row[k].text == "{" else None
        if b is not None:
            return Function(None, row[b].group, row[b].line, row[b].end, first, b + 1)
        e = _expression_end(row, k, "rs")
        if e > k:
            return Function(None, row[k:e], row[k].line, row[e - 1].end, first, e, False)
    return None


def go_function(row: list[Token], i: int) -> Function | None:
    if row[i].text != "func" or row[i].kind != "keyword":
        return None
    k, owner, name = i + 1, None, None
    if k + 1 < len(row) and row[k].text == "(" and row[k + 1].kind == "name" and k + 2 < len(row) and (row[k + 2].text in ("(", "[")):
        # a receiver, or a literal with a result type and no name
        nxt = row[k + 2]
        if nxt.text == "(" or (k + 3 < len(row) and row[k + 3].text == "("):
            names = [x.text for x in row[k].group if x.kind == "name"]
            owner, name = (names[1] if len(names) > 1 else names[0] if names else "_"), row[k + 1].text
            k += 2
    if name is None and k < len(row) and row[k].kind == "name":
        name = row[k].text
        k += 1
    if k < len(row) and row[k].text == "[":
        k += 1
    if k >= len(row) or row[k].text != "(":
        return None
    b = _body_after(row, k + 1, frozenset([",", ";", "="]))
    if b is None:
        return None
    full = qualified(owner, name) if name else None
    return Function(full, row[b].group, row[b].line, row[b].end, i, b + 1)


def ts_function(row: list[Token], i: int, in_class: bool) -> Function | None:
    t = row[i]
    if t.text == "function" and t.kind == "keyword":
        k = i + 1
        if k < len(row) and row[k].text == "*":
            k += 1
        name = None
        if k < len(row) and row[k].kind == "name":
            name = row[k].text
            k += 1
        k = _skip_angles(row, k)
        if k < len(row) and row[k].text == "(":
            b = _body_after(row, k + 1, frozenset([";"]))
            if b is not None:
                return Function(name, row[b].group, row[b].line, row[b].end, i, b + 1)
        return None
    if in_class and t.kind in ("name", "keyword", "lit_str") and (i == 0 or row[i - 1].text not in (".", "new", "=", "(")):
        k = _skip_angles(row, i + 1)
        if k < len(row) and row[k].text == "(" and (k + 1 < len(row)) and (row[k + 1].text in ("{", ":")):
            b = _body_after(row, k + 1, frozenset([";", "="]))
            if b is not None:
                return Function(t.text, row[b].group, row[b].line, row[b].end, i, b + 1)
    arrow = None
    if t.kind == "open" and t.text == "(":
        k = i + 1
        if k < len(row) and row[k].text == ":":
            while k < len(row) and row[k].text not in ("=>", ";", ",", "="):
                k += 1
        arrow = k if k < len(row) and row[k].text == "=>" else None
    elif t.kind == "name" and i + 1 < len(row) and row[i + 1].text == "=>":
        arrow = i + 1
    if arrow is None or arrow + 1 >= len(row):
        return None
    first = i - 1 if i and row[i - 1].text == "async" else i
    b = arrow + 1
    if row[b].kind == "open" and row[b].text == "{":
        return Function(None, row[b].group, row[b].line, row[b].end, first, b + 1)
    e = _expression_end(row, b, "ts")
    return Function(None, row[b:e], row[b].line, row[e - 1].end, first, e, False)


def _type_end(row: list[Token], at: int) -> int:
    """The end of a Rust type that starts at ``at``."""
    i = at
    while i < len(row):
        t = row[i]
        if t.text in ("&", "&&", "*", "'_", "dyn", "impl", "mut", "const", "!"):
            i += 1
        elif t.text == "<":
            i = _skip_angles(row, i)
            if i < len(row) and row[i].text == "::":
                i += 1
                continue
            return i
        elif t.group is not None and t.text != "{":
            return i + 1
        elif t.kind in ("name", "keyword"):
            i += 1
            if i < len(row) and row[i].text == "::":
                i += 1
                continue
            if i < len(row) and row[i].text == "<" and i + 1 < len(row) and _skip_angles(row, i) < len(row) + 1 and t.text[:1].isupper():
                return _skip_angles(row, i)
            return i
        else:
            return i
    return i


def rust_reduced(row: list[Token]) -> list[Token]:
    """The row without what doesn't tell Rust bodies apart: labels of loops, types of casts and of let, turbofish, guards of match arms, what a let-else does otherwise."""
    out: list[Token] = []
    i, let, head = 0, False, 0  # head: where the statement or arm starts in ``out``
    text = lambda k: row[k].text if k < len(row) else ""
    while i < len(row):
        t = row[i]
        if t.text in (";", ",") and t.kind == "op":
            let, head = False, len(out) + 1
        elif t.text == "let" and t.kind == "keyword" and len(out) == head:
            let = True
        if t.text == "'_" and ((text(i + 1) == ":" and text(i + 2) in ("loop", "while", "for", "{")) or (out and out[-1].text in ("break", "continue"))):
            i += 2 if text(i + 1) == ":" else 1
        elif t.text == "as" and t.kind == "keyword":
            out.append(t)
            i = max(_type_end(row, i + 1), i + 1)
        elif t.text == "::" and text(i + 1) == "<":
            i = _skip_angles(row, i + 1)
        elif let and t.text == ":" and t.kind == "op":
            out.append(t)
            i += 1
            while i < len(row) and row[i].text not in ("=", ";"):
                i = _skip_angles(row, i) if row[i].text == "<" else i + 1
            let = False
        elif t.text == "else" and let and text(i + 1) == "{" and out[-1].text != "{":
            i += 2
        elif t.text == "if" and len(out) > head and out[-1].text not in ("=>", "else", "=", "return"):
            k = i + 1
            while k < len(row) and row[k].text not in ("=>", "{", ",", ";"):
                k += 1
            if text(k) == "=>":
                i = k
            else:
                out.append(t)
                i += 1
        else:
            out.append(t)
            i += 1
            if t.group is not None and t.text == "{":
                let, head = False if text(i) != "else" else let, len(out)
    return out


class Extractor:
    STUBS = {"rs": "closure", "go": "func_literal", "ts": "arrow_function"}
    ANONYMOUS = {"rs": "$closure", "go": "$literal", "ts": "$arrow"}

    def __init__(self, lang: str, out: Collector, kind: str):
        self.lang, self.out, self.kind = lang, out, kind

    def function_at(self, row: list[Token], i: int, in_class: bool) -> Function | None:
        if self.lang == "rs":
            return rust_function(row, i)
        return go_function(row, i) if self.lang == "go" else ts_function(row, i, in_class)

    # -- which functions there are

    def walk(self, row: list[Token], owner: str | None, parent: str | None, test: bool, in_class: bool = False, fn_test: bool = False) -> None:
        """``test``: inside a module for tests (Rust); ``fn_test``: inside a test function, which closures inherit."""
        i, attrs = 0, []
        while i < len(row):
            t = row[i]
            if self.lang == "rs" and t.text == "#" and i + 1 < len(row) and row[i + 1].text in ("[", "!"):
                at = i + 1 if row[i + 1].text == "[" else i + 2
                if at < len(row) and row[at].group is not None:
                    attrs.append(row[at].group)
                i = at + 1
                continue
            f = self.function_at(row, i, in_class)
            if f is not None:
                self.found(row, f, owner, parent, test, fn_test, attrs)
                attrs = []
                for skipped in row[i : f.last - (1 if f.braced else len(f.body))]:
                    if skipped.group:
                        self.walk(skipped.group, None, parent, test, fn_test=fn_test)
                i = f.last
                continue
            if t.kind == "keyword" and t.text in ("mod", "impl", "trait", "class", "interface", "struct", "enum"):
                b = i + 1
                while b < len(row) and not (row[b].kind == "open" and row[b].text == "{") and row[b].text != ";":
                    b += 1
                if b < len(row) and row[b].group is not None and row[b].text == "{":
                    inner = test or (self.lang == "rs" and t.text == "mod" and any(cfg_test(a) for a in attrs))
                    self.walk(row[b].group, self.owner_name(t.text, row[i + 1 : b]), parent, inner, in_class=t.text == "class")
                    attrs = []
                    i = b + 1
                    continue
            if t.group is not None:
                self.walk(t.group, None, parent, test, in_class=self.lang == "ts" and t.text == "{" and in_class, fn_test=fn_test)
            if t.text in (";", "{"):
                attrs = []
            i += 1

    def owner_name(self, word: str, header: list[Token]) -> str | None:
        if word == "impl":
            at = 0
            at = _skip_angles(header, at)
            rest = header[at:]
            cut = next((k for k, x in enumerate(rest) if x.text == "for" and x.kind == "keyword"), None)
            if cut is not None:
                rest = rest[cut + 1 :]
            names: list[str] = []
            depth = 0
            for x in rest:
                if x.text == "where" or (x.text == "<" and depth == 0 and names):
                    break
                if x.kind == "name":
                    names.append(x.text)
            return names[-1] if names else "Impl"
        if word in ("trait", "class"):
            return next((x.text for x in header if x.kind == "name"), "_")
        return None

    def found(self, row: list[Token], f: Function, owner: str | None, parent: str | None, test: bool, fn_test: bool, attrs: list[list[Token]]) -> None:
        own_test = self.lang == "rs" and any(test_attr(a) or cfg_test(a) for a in attrs)
        is_test = test or own_test or (f.name is None and fn_test)
        kind = TEST if self.kind == TEST or is_test else PRODUCTION
        if f.name is not None:
            name = f.name if self.lang == "go" else qualified(owner, f.name)
        else:
            name = self.bound_name(row, f) or f"{parent + '.' if parent and self.lang != 'ts' else ''}{self.anonymous(row[f.first])}:L{row[f.first].line}"
        if self.out.wants(f.start, f.end):
            names = Placeholders()
            tree = branch("block", self.statements(f.body, names))
            self.out.add(name, f.start, f.end, kind, tree, names.trace)
        self.walk(f.body, None, name, test, fn_test=own_test or (f.name is None and fn_test))

    def anonymous(self, first: Token) -> str:
        return "$function" if self.lang == "ts" and first.text == "function" else self.ANONYMOUS[self.lang]

    def bound_name(self, row: list[Token], f: Function) -> str | None:
        """The variable that an arrow or function expression is assigned to."""
        i = f.first
        if self.lang == "ts" and i >= 2 and row[i - 1].text == "=":
            k = i - 2
            while k > 0 and row[k].text not in ("const", "let", "var", ";"):
                k -= 1
            return next((x.text for x in row[k:i] if x.kind == "name"), None)
        return None

    # -- trees

    def statements(self, row: list[Token], names: Placeholders) -> list[Node]:
        """A node for each statement; in Go and TypeScript a new line may end one."""
        out: list[Node] = []
        now: list[Node] = []
        i = 0
        prev: Token | None = None
        row = rust_reduced(row) if self.lang == "rs" else row
        while i < len(row):
            t = row[i]
            ended = self.lang != "rs" and prev is not None and t.after_newline and not (t.kind == "op" and t.text in (".", "?.", "&&", "||", "+", "?", ":", "=>")) and not (prev.kind == "op" and prev.text not in ("++", "--"))
            if (t.kind == "op" and t.text == ";") or ended:
                if now:
                    out.append(branch("stmt", now))
                    now = []
                if not ended:
                    prev = t
                    i += 1
                    continue
            f = self.function_at(row, i, False)
            if f is not None:
                now.append(leaf(self.STUBS[self.lang] if f.name is None else "function"))
                prev = row[f.last - 1]
                i = f.last
                continue
            now.append(self.token(t, names))
            if t.kind == "open" and t.text == "{" and (i + 1 == len(row) or row[i + 1].text not in ("else", ".", "?", ")", ",", "catch", "finally", "(")) and (prev is None or not (prev.kind == "op" and prev.text in ("=", ":=", "(", ","))):
                out.append(branch("stmt", now))
                now = []
            prev = t
            i += 1
        if now:
            out.append(branch("stmt", now))
        return out

    def token(self, t: Token, names: Placeholders) -> Node:
        if t.kind == "name":
            return leaf(names(t.text.removeprefix("r#")))
        if t.group is not None:
            return branch(GROUPS[t.text], self.statements(t.group, names) if t.text == "{" else self.items(t.group, names))
        return leaf(t.kind if t.kind.startswith("lit_") or t.kind == "template" else t.text)

    def items(self, row: list[Token], names: Placeholders) -> list[Node]:
        """The comma-separated items of a group."""
        parts: list[Node] = []
        now: list[Node] = []
        i = 0
        row = rust_reduced(row) if self.lang == "rs" else row
        while i < len(row):
            t = row[i]
            f = self.function_at(row, i, False)
            if f is not None:
                now.append(leaf(self.STUBS[self.lang] if f.name is None else "function"))
                i = f.last
                continue
            if t.kind == "op" and t.text in (",", ";"):
                parts.append(now[0] if len(now) == 1 else branch("item", now))
                now = []
            else:
                now.append(self.token(t, names))
            i += 1
        if now:
            parts.append(now[0] if len(now) == 1 else branch("item", now))
        return parts


def test_attr(attr: list[Token]) -> bool:
    """An attribute whose path ends in ``test``."""
    path = []
    for t in attr:
        if t.kind == "name":
            path.append(t.text)
        elif t.text != "::":
            break
    return bool(path) and path[-1] == "test"


def cfg_test(attr: list[Token]) -> bool:
    """``cfg`` with ``test`` in it that isn't negated."""

    def positive(row: list[Token], sign: bool) -> bool:
        for k, t in enumerate(row):
            if t.kind == "name" and k + 1 < len(row) and row[k + 1].group is not None:
                if t.text in ("any", "all") and positive(row[k + 1].group, sign):
                    return True
                if t.text == "not" and positive(row[k + 1].group, not sign):
                    return True
            elif t.kind == "name" and t.text == "test" and sign and not (k + 1 < len(row) and row[k + 1].text == "="):
                return True
        return False

    return len(attr) >= 2 and attr[0].text == "cfg" and attr[1].group is not None and positive(attr[1].group, True)


def normalize(lang: str, path: str, source: str, marker: str, min_nodes: int, min_lines: int) -> list[Form]:
    if lang == "ts" and re.search(r"\.d\.(ts|mts|cts|tsx)$", path):
        return []
    out = Collector(source, marker, min_nodes, min_lines)
    try:
        Extractor(lang, out, kind_from_path(path, lang)).walk(nest(tokens(source, lang)), None, None, False)
    except RecursionError as e:
        raise ParseError("parse error: nested too deeply") from e
    return out.forms
